"""Trains the network of ``abuse`` in numpy: python -m tessera.llm.abuse_train SF_DIR.

Positives are sentences put together from the word lists below, which say in general what
insults, threats, degradation of groups and sexual harassment are made of, disguised at
random, and the windows of documents that annotators marked, chosen by the network itself
(multiple-instance learning); negatives are windows of documents marked harmless and
sentences that use the same words harmlessly. At most MOST_LABELS labels are read, and of
no other document the text. Labels that the network of the first round contradicts strongly
are left out of the second, since some are wrong. Of five labelled documents, by their
ids, three train the network, one sets the threshold and one is held out.
"""

from __future__ import annotations

import random
import re
import sys
from collections import defaultdict

import numpy as np

from tessera.llm import abuse as A

MOST_LABELS, EPOCHS, BATCH, RATE = 20_000, 12, 512, 0.006
HELD_OUT = 5

# General vocabulary by language, alternatives divided by |. Slots in braces are filled from the other entries;
# {n} is an invented word, {N} an invented name of a group.
WORDS = {
    "en": {
        "i": "idiot|moron|imbecile|loser|bastard|bitch|asshole|dickhead|dumbass|scumbag|jerk|prick|wanker|twat|cunt|whore|slut|pig|dog|rat|worm|clown|fool|freak|creep|coward|liar|halfwit|retard|degenerate|lowlife|parasite|leech|trash|garbage|filth|scum|failure|nobody|disgrace|cow|snake|tramp|ape|monkey|piece of shit|piece of crap|sack of shit|waste of space|waste of oxygen",
        "a": "stupid|dumb|fucking|bloody|damn|goddamn|pathetic|worthless|useless|filthy|dirty|ugly|fat|lazy|disgusting|miserable|rotten|brainless|clueless|spineless|vile|lousy|sick|stinking|sorry|ignorant|hopeless|wretched|braindead",
        "e": "nobody likes you|everyone hates you|nobody would miss you|you disgust me|you make me sick|you stink|no one wants you|nobody can bear you|you are nothing|you will never amount to anything|your parents regret you|get out of my sight|go away and die|crawl away|rot in hell|you deserve nothing|we all laugh at you|even your mother hates you|you ruin everything",
        "v": "kill|murder|beat|stab|shoot|strangle|hurt|punch|kick|slap|hang|cut|burn|drown|choke|destroy|smash|cripple|bury|hunt down",
        "k": "your family|your children|your wife|your kids|your mother|your dog",
        "bp": "face|neck|legs|arms|skull|teeth|nose|jaw|hands|fingers|knees|ribs|bones|head",
        "br": "break|smash|crush|cut off|kick in|knock out|snap|bash in",
        "self": "kill yourself|hang yourself|drop dead|jump in front of a train|shoot yourself|end your life|drink bleach|cut your wrists|jump off a roof|go die|drown yourself",
        "dies": "die|die slowly|get cancer|get hit by a truck|suffer|burn in hell|choke|lose everything|rot|bleed to death|end up in a ditch|crash your car",
        "g": "women|men|gays|lesbians|blacks|whites|Asians|Arabs|Africans|Mexicans|Jews|Muslims|Christians|Hindus|atheists|foreigners|immigrants|migrants|refugees|gypsies|trans people|disabled people|old people|fat people|poor people|homeless people|Poles|Turks|Russians|Americans|the {N}|{N}|the {n} people|these {N}|those {N}",
        "x": "vermin|rats|cockroaches|animals|apes|pigs|dogs|insects|parasites|leeches|criminals|thieves|liars|rapists|terrorists|savages|subhuman|inferior|worthless|filth|scum|trash|a disease|a cancer|a plague|stupid by nature|born criminals|too dumb to learn|dirty and lazy|less than human|mentally inferior|lazy and dishonest|untrustworthy|unfit for work",
        "y": "shot|hanged|killed|exterminated|wiped out|gassed|deported|thrown out|locked up|driven out|eliminated|put down|sterilized|banned from working|sent back|kicked out|whipped|enslaved|kept away|removed from society|driven into the sea|stripped of all rights",
        "y2": "kill|shoot|hang|exterminate|deport|gas|get rid of|throw out|lock up|wipe out|burn|beat up|kick out|sterilize",
        "vv": "think|read|count|learn|drive|lead|work|behave|breathe|vote|raise children|manage anything",
        "dm": "stupid|dumb|weak|lazy|primitive|emotional|slow|dirty|greedy",
        "right": "rights|jobs|a vote|respect|to live|to exist|a place here|our help|children|any mercy",
        "pl": "here|this country|our town|our school|the company|the team|this world|our industry|our neighbourhood|any office",
        "p": "tits|boobs|breasts|ass|cock|dick|pussy|cunt|nipples|butt|thighs|legs|body|panties|bra|naked body|wet pussy|hard cock|big tits|bare ass|cleavage",
        "f": "fuck|screw|lick|suck|bang|ride|spank|touch|grope|undress|rape|finger|kiss|have sex with|sleep with|make love to|strip",
        "sx": "horny|naked|nude|topless|wet|hot|sexy|slutty|kinky|hard|aroused|willing|dirty|barely legal|busty",
        "w": "girls|women|teens|wives|chicks|milfs|babes|sluts|models|singles|students|housewives|boys|men|couples|ladies",
        "pn": "porn|sex videos|nudes|xxx clips|hardcore movies|sex chat|live sex|escorts|blowjobs|orgies|gangbang|webcam show|sex tape|adult films|nude pics|cumshots|hookups",
        "act": "moaned|came|orgasmed|thrust|stripped|undressed|spread her legs|groaned with pleasure|took off her clothes|grabbed her breasts|pushed inside her|sucked him off|rode him|unzipped his trousers|went down on her|slid a hand between her legs",
        "job": "boss|developer|manager|colleague|teacher|intern|reviewer|neighbour|engineer|guy|woman|man|girl|student|nurse|tester|writer",
    },
    "de": {
        "i": "Idiot|Trottel|Depp|Vollpfosten|Vollidiot|Arschloch|Arsch|Wichser|Hurensohn|Hure|Schlampe|Fotze|Bastard|Schwein|Sau|Drecksau|Esel|Ratte|Affe|Versager|Penner|Spinner|Spasti|Schwachkopf|Hohlkopf|Mistkerl|Dreckskerl|Miststück|Lügner|Feigling|Abschaum|Dreck|Müll|Stück Scheiße|Stück Dreck|Missgeburt|Krüppel|Nichtsnutz|Blödmann|Null|Pfeife|Dummkopf",
        "a": "dummer|blöder|verdammter|beschissener|verfickter|elender|nutzloser|wertloser|dreckiger|fetter|hässlicher|fauler|erbärmlicher|widerlicher|mieser|ekelhafter|verlogener|bescheuerter|hirnloser|dumme|blöde|fette|faule",
        "e": "niemand mag dich|alle hassen dich|du kotzt mich an|du bist nichts wert|keiner will dich|du stinkst|hau ab|verschwinde|du widerst mich an|geh sterben|schäm dich|alle lachen über dich|du bist das Letzte",
        "v": "umbringen|töten|verprügeln|erschießen|abstechen|erwürgen|zusammenschlagen|fertigmachen|kaltmachen|anzünden|verbrennen|aufhängen",
        "br": "breche|schlage|trete|haue|schneide|reiße", "bp": "das Genick|die Beine|die Nase|die Zähne aus|den Schädel ein|die Finger|die Knochen|den Kiefer|das Gesicht ein|die Arme",
        "self": "bring dich um|häng dich auf|geh sterben|verreck|stirb endlich|spring vom Dach|erschieß dich|fahr zur Hölle|krepier",
        "g": "Ausländer|Flüchtlinge|Frauen|Männer|Schwule|Lesben|Juden|Muslime|Moslems|Türken|Polen|Araber|Afrikaner|Schwarze|Zigeuner|Behinderte|Alte|Arme|Obdachlose|Migranten|Asylanten|Christen|die {N}|{N}|diese {N}",
        "x": "Ungeziefer|Ratten|Tiere|Affen|Schweine|Parasiten|Verbrecher|Diebe|Lügner|Vergewaltiger|Terroristen|Untermenschen|minderwertig|Abschaum|Dreck|Gesindel|Pack|Pest|Krankheit|dumm und faul|zu dumm zum Arbeiten|von Natur aus dumm|asozial|kriminell",
        "y": "erschossen|vergast|aufgehängt|abgeschoben|ausgerottet|rausgeworfen|eingesperrt|vertrieben|vernichtet|totgeschlagen|weggesperrt|verbrannt|rausgeschmissen", "pl": "hier|diesem Land|unserer Stadt|der Firma|unserem Team|Deutschland",
        "p": "Titten|Brüste|Arsch|Schwanz|Möse|Muschi|Hintern|Busen|Körper|Schenkel|Nippel", "f": "ficken|lecken|blasen|bumsen|vögeln|anfassen|begrapschen|ausziehen|küssen|vergewaltigen|besteigen|nehmen", "sx": "geil|nackt|nackte|feucht|heiß|geile|scharf|versaute|willige|notgeile",
        "w": "Frauen|Mädchen|Weiber|Hausfrauen|Girls|Studentinnen|Schlampen|Teens|Luder", "pn": "Pornos|Sexvideos|Nacktbilder|Nacktfotos|Sexchat|Livesex|Pornofilme|Sexkontakte", "act": "stöhnte|kam|zog sich aus|spreizte die Beine|riss ihr die Kleider vom Leib|fasste ihr an die Brüste|drang in sie ein|blies ihm einen|zog ihr das Höschen aus|griff ihr zwischen die Beine",
        "job": "Chef|Entwickler|Kollege|Kollegin|Nachbar|Typ|Frau|Lehrer|Praktikant|Tester",
    },
    "fr": {
        "i": "imbécile|idiot|crétin|abruti|connard|connasse|con|conne|salaud|salope|pute|putain|enculé|bâtard|ordure|porc|chien|rat|truie|vache|clown|bouffon|débile|mongol|attardé|taré|raté|minable|minus|merde|grosse merde|déchet|parasite|lâche|menteur|fils de pute|sac à merde|sous-merde|trou du cul|pauvre type|pauvre con|incapable|bon à rien|tocard",
        "a": "sale|gros|grosse|pauvre|espèce de|putain de|foutu|vieux|vieille|maudit|petit|stupide|misérable|immonde",
        "e": "personne ne t'aime|tout le monde te hait|tu me dégoûtes|tu ne vaux rien|tu pues|dégage|casse-toi|tire-toi|tu fais pitié|va mourir|tu me donnes envie de vomir|on rit de toi|tu n'es rien|ta mère a honte",
        "v": "tuer|buter|crever|frapper|cogner|égorger|étrangler|tabasser|massacrer|brûler|pendre|planter|défoncer|démolir|écraser",
        "br": "casser|péter|briser|exploser|arracher|éclater|couper", "bp": "la gueule|les jambes|les dents|le nez|les doigts|le crâne|les bras|la mâchoire|les os|la nuque|les genoux",
        "self": "suicide-toi|va crever|crève|pends-toi|tue-toi|va te pendre|jette-toi du toit|va au diable|meurs",
        "g": "étrangers|immigrés|migrants|réfugiés|femmes|hommes|homosexuels|pédés|lesbiennes|juifs|musulmans|arabes|noirs|chinois|africains|gitans|roms|handicapés|vieux|pauvres|chrétiens|{N}",
        "x": "rats|cafards|animaux|singes|porcs|parasites|voleurs|criminels|violeurs|menteurs|terroristes|sous-hommes|sauvages|déchets|inférieurs|débiles|vermine|racaille|fainéants|barbares", "x2": "vermine|racaille|merde|peste|maladie|saleté|honte|plaie",
        "y": "fusiller|tuer|gazer|pendre|expulser|exterminer|enfermer|virer|éliminer|chasser|brûler|renvoyer|parquer|stériliser", "pl": "ici|ce pays|notre ville|l'entreprise|notre équipe|la France",
        "p": "seins|nichons|fesses|cul|bite|chatte|queue|cuisses|corps|poitrine|tétons", "f": "baiser|lécher|sucer|niquer|toucher|tripoter|déshabiller|embrasser|violer|prendre|sauter|caresser", "sx": "nue|nues|chaude|chaudes|excitée|coquine|salope|mouillée|bandante|sexy|à poil",
        "w": "filles|femmes|cochonnes|étudiantes|nanas|coquines|mères|gamines", "pn": "porno|vidéos de sexe|photos de cul|films X|sexe en direct|plans cul|photos nues|cam sexe", "act": "gémissait|jouissait|se déshabilla|écarta les cuisses|lui arracha sa culotte|la pénétra|lui caressa les seins|le suça|glissa la main entre ses cuisses",
        "job": "chef|développeur|collègue|voisin|type|prof|stagiaire|bonne femme|mec",
    },
    "es": {
        "i": "idiota|imbécil|estúpido|tonto|gilipollas|cabrón|cabrona|capullo|mamón|pendejo|puta|zorra|perra|puto|hijo de puta|hijo de perra|bastardo|cerdo|cerda|rata|perro|burro|payaso|subnormal|retrasado|tarado|fracasado|inútil|basura|mierda|pedazo de mierda|escoria|parásito|cobarde|mentiroso|asqueroso|desgraciado|malnacido|anormal|don nadie|lameculos|bobo",
        "a": "maldito|puto|puta|asqueroso|sucio|gordo|gorda|feo|pobre|estúpido|jodido|pinche|miserable|repugnante|vago|viejo|pedazo de|inútil",
        "e": "nadie te quiere|todos te odian|me das asco|no vales nada|apestas|lárgate|vete|das pena|púdrete|todos se ríen de ti|no eres nadie|das vergüenza|ojalá te mueras|ni tu madre te quiere",
        "v": "matar|golpear|pegar|apuñalar|disparar|ahorcar|estrangular|quemar|reventar|destrozar|degollar|aplastar|machacar|rajar",
        "br": "romper|partir|reventar|arrancar|cortar|machacar|aplastar", "bp": "la cara|las piernas|los dientes|la nariz|los dedos|el cuello|los huesos|la cabeza|la boca|los brazos|las rodillas",
        "self": "mátate|muérete|suicídate|cuélgate|pégate un tiro|tírate por la ventana|vete al infierno|ahórcate",
        "g": "extranjeros|inmigrantes|refugiados|migrantes|mujeres|hombres|maricones|gays|lesbianas|judíos|musulmanes|moros|negros|chinos|gitanos|africanos|discapacitados|viejos|pobres|cristianos|sudacas|{N}",
        "x": "ratas|cucarachas|animales|monos|cerdos|parásitos|ladrones|criminales|violadores|mentirosos|terroristas|salvajes|inferiores|infrahumanos|vagos|delincuentes|bestias|tontos", "x2": "plaga|escoria|basura|peste|mierda|enfermedad|vergüenza|lacra",
        "y": "fusilar|matar|gasear|ahorcar|expulsar|exterminar|encerrar|echar|eliminar|quemar|deportar|esterilizar|azotar", "pl": "aquí|este país|nuestra ciudad|la empresa|nuestro equipo|España",
        "p": "tetas|pechos|culo|polla|coño|nalgas|piernas|cuerpo|pezones|bragas", "f": "follar|chupar|lamer|tocar|manosear|desnudar|besar|violar|tirarme|montar|cogerte|acariciar", "sx": "desnuda|desnudas|cachonda|cachondas|caliente|calientes|mojada|guarra|sexy|en pelotas",
        "w": "chicas|mujeres|zorras|universitarias|maduras|jovencitas|guarras|madres", "pn": "porno|vídeos de sexo|fotos desnuda|películas X|sexo en vivo|contactos sexuales|sexo gratis", "act": "gemía|se corrió|se desnudó|abrió las piernas|le arrancó las bragas|la penetró|le tocó los pechos|se la chupó|metió la mano entre sus muslos",
        "job": "jefe|programador|colega|vecino|tío|profesor|becario|tía|compañero",
    },
}
#: What the words are put together to, by kind.
FRAMES = {
    "en": {
        "insult": "you {a} {i}|you {i}|you are a {a} {i}|you are such a {i}|what a {a} {i} you are|you {a} {i}, {e}|{e}, you {i}|listen {i}, {e}|shut up {i}|shut the fuck up you {i}|fuck you {i}|fuck off you {a} {i}|screw you|go to hell {i}|piss off {i}|get lost you {i}|he is a {a} {i}|she is nothing but a {a} {i}|that {job} is a {a} {i}|our {job} is a {i}|{n} is a {a} {i}|{n} you are a {i}|only a {i} like you would do that|how {a} can you be you {i}|are you {a} or just a {i}|kiss my ass {i}|eat shit {i}|{e}|shame on you {i}|you people are {a} {i}s|both of you are {i}s|your brain is the size of a pea, {i}|you are too {dm} to {vv}|you look like a {i}|you and your {a} {job}, {i}s all of you",
        "threat": "i will {v} you|i am going to {v} you|i will {v} {k}|i swear i will {v} you and {k}|i will {br} your {bp}|i am going to {br} your {bp}|somebody should {v} you|someone ought to {v} that {job}|you deserve to be {y}|i hope you {dies}|i hope {n} {dies}s|i hope {k} {dies}|{self}|please {self}|why don't you {self}|just {self} already|you should {self}|do the world a favour and {self}|we will find you and {v} you|i know where you live and i will {v} you|we know where you sleep|watch your back {i}|you are dead|you are a dead man|next time i see you i will {br} your {bp}|wait until i {v} you|touch it again and i {v} you|i will make you bleed|your days are numbered {i}|i am coming for you and {k}|we will {v} {k} while you watch|they should {br} your {bp}",
        "hate": "{g} are {x}|all {g} are {x}|{g} are nothing but {x}|{g} are {a} {x}|{g} should be {y}|all {g} must be {y}|{y2} all {g}|we should {y2} the {N}|time to {y2} {g}|{g} don't deserve {right}|{g} do not belong {pl}|{g} have no place in {pl}|keep {g} out of {pl}|no {g} in {pl}|get {g} out of {pl}|i hate {g}|i hate all {g}, they are {x}|never trust {g}, they are {x}|{g} are too {dm} to {vv}|{g} can't {vv}, they are {x}|{g} breed like {x}|{g} ruin {pl}|the world would be better without {g}|send {g} back home, they are {x}|{g} stink|never hire {g}|{g} belong in the kitchen|{g} belong in a cage|death to {g}|a {i} like all {g}|typical {N}, {dm} and {dm}|{n} is one of those {N}, {x} all of them|people like {g} should be {y}",
        "sexual": "i want to {f} you|i want to {f} your {p}|let me {f} your {p}|show me your {p}|send me your {pn}|send me a picture of your {p}|your {p} make me {sx}|nice {p}|what are you wearing, {sx}|are you {sx}|come to my bed|sleep with me|sleep with me or you are fired|i think of your {p} at night|i bet your {p} taste good|{sx} {w}|{sx} {w} near you|{sx} {w} {pn}|free {pn}|watch {sx} {w} {f} live|hot {pn} with {sx} {w}|download {pn} here|she {act}|he {act}|she {act} as he {act}|he {act} while she {act}|he licked her {p}|she touched his {p}|i get {sx} when i see your {p}|sit on my lap and let me {f} you|your {job} wants to {f} you|meet {sx} {w} tonight|{w} want to {f} you|bend over|i would {f} that {job} all night|your {p} looked great in that skirt",
    },
    "de": {
        "insult": "du {a} {i}|du {i}|du bist ein {a} {i}|du bist echt ein {i}|was für ein {a} {i}|{e}, du {i}|{e}|halt die Klappe, du {i}|halt die Fresse {i}|halt dein Maul {i}|verpiss dich {i}|leck mich {i}|fick dich {i}|fick dich ins Knie|so ein {i}|{n} ist ein {a} {i}|der {job} ist ein {i}|dieser {job} ist ein {a} {i}|sie ist eine {i}|ihr {i}|wie blöd bist du eigentlich|bist du {a} oder nur ein {i}|nur ein {i} macht so etwas|du hast doch kein Hirn|zu dumm zum Atmen, du {i}",
        "threat": "ich werde dich {v}|ich will dich {v}|man sollte dich {v}|jemand sollte {n} {v}|wir werden dich {v}|ich {br} dir {bp}|ich {br} dir gleich {bp}|{self}|{self}, du {i}|ich hoffe du stirbst|du bist tot|ich weiß wo du wohnst|wir finden dich|pass auf deine Kinder auf|deine Familie ist als Nächstes dran|ich mach dich kalt|du gehörst {y}|noch ein Wort und ich {br} dir {bp}|wenn ich dich erwische {br} ich dir {bp}",
        "hate": "{g} sind {x}|alle {g} sind {x}|{g} sind nur {x}|{g} gehören {y}|alle {g} sollten {y} werden|{g} raus aus {pl}|{g} raus|{g} haben in {pl} nichts verloren|{g} haben hier nichts zu suchen|kein Platz für {g}|ich hasse {g}|ich hasse alle {g}, das sind {x}|traue nie einem {N}, alles {x}|{g} gehören an den Herd|{g} gehören in den Käfig|{g} stinken|{g} sind zu dumm zum Denken|ohne {g} wäre alles besser|diese {x} von {g}|Tod den {g}|stellt keine {g} ein, das sind {x}",
        "sexual": "ich will dich {f}|ich will deine {p} {f}|zeig mir deine {p}|zeig deinen {p}|schick mir {pn}|deine {p} machen mich {sx}|geile {p}|{sx} {w}|{sx} {w} in deiner Nähe|kostenlose {pn}|{pn} mit {sx} {w}|komm in mein Bett|schlaf mit mir|ich denke nachts an deine {p}|lass mich deine {p} {f}|sie {act}|er {act}|sie {act}, er {act}|{w} wollen {f}|ich bin so {sx}|zieh dich aus|setz dich auf meinen Schoß",
    },
    "fr": {
        "insult": "{a} {i}|espèce de {i}|espèce de {a} {i}|tu es un {i}|tu es un {a} {i}|t'es qu'un {i}|quel {i}|quel {a} {i}|{e}, {i}|{e}|ferme ta gueule {i}|ta gueule {i}|ferme-la {i}|va te faire foutre {i}|va te faire enculer|nique ta mère|nique ta race {i}|je t'emmerde {i}|{n} est un {i}|ce {job} est un {i}|notre {job} est un {a} {i}|bande de {i}s|tu n'as rien dans le crâne|seul un {i} ferait ça|tu es trop bête pour vivre",
        "threat": "je vais te {v}|je vais la {v}|on va te {v}|je vais {v} ta famille|je vais te {br} {bp}|on va te {br} {bp}|{self}|{self}, {i}|j'espère que tu vas crever|tu es mort|je sais où tu vis|on va te retrouver|fais gaffe à tes enfants|tu mérites qu'on te {v}|quelqu'un devrait te {v}|encore un mot et je te {v}|la prochaine fois je te {br} {bp}",
        "hate": "les {g} sont des {x}|tous les {g} sont des {x}|les {g} sont de la {x2}|ces {g}, quelle {x2}|il faut {y} les {g}|il faut {y} tous les {g}|on devrait {y} les {g}|les {g} dehors|dehors les {g}|pas de {g} dans {pl}|les {g} n'ont pas leur place dans {pl}|je hais les {g}|je déteste les {g}, tous des {x}|mort aux {g}|les {g} puent|les {g} sont trop bêtes pour penser|les {g} à la cuisine|n'embauchez jamais de {g}, ce sont des {x}|sans les {g} tout irait mieux|les {g} sont une {x2}",
        "sexual": "je veux te {f}|je veux {f} ta {p}|je veux te voir {sx}|montre-moi tes {p}|montre ta {p}|envoie-moi des {pn}|tes {p} m'excitent|beaux {p}|{w} {sx}|{w} {sx} près de chez toi|{pn} gratuit|{pn} avec {w} {sx}|viens dans mon lit|couche avec moi|je rêve de tes {p}|laisse-moi te {f}|elle {act}|il {act}|elle {act}, il {act}|déshabille-toi|assieds-toi sur mes genoux|tu es {sx}|j'ai envie de te {f}",
    },
    "es": {
        "insult": "{a} {i}|eres un {i}|eres un {a} {i}|eres una {i}|qué {i} eres|vaya {i}|menudo {i}|{e}, {i}|{e}|cállate {i}|cierra el pico {i}|vete a la mierda {i}|que te jodan {i}|que te den por culo|jódete {i}|chúpamela {i}|{n} es un {i}|ese {job} es un {a} {i}|nuestro {job} es un {i}|sois unos {i}s|panda de {i}s|no tienes cerebro|solo un {i} haría eso|eres demasiado tonto para vivir|tu madre es una {i}",
        "threat": "te voy a {v}|voy a {v} a tu familia|vamos a {v} te|te vamos a {v}|te voy a {br} {bp}|alguien debería {v}te|habría que {v}te|{self}|{self}, {i}|ojalá te mueras|ojalá te atropellen|estás muerto|sé dónde vives|te vamos a encontrar|cuida a tus hijos|mereces morir|una palabra más y te {br} {bp}|la próxima vez te voy a {br} {bp}",
        "hate": "los {g} son {x}|las {g} son {x}|todos los {g} son {x}|los {g} son unos {x}|los {g} son una {x2}|hay que {y} a los {g}|hay que {y} a todos los {g}|deberían {y} a los {g}|fuera los {g}|los {g} fuera de {pl}|no queremos {g} en {pl}|odio a los {g}|odio a los {g}, son {x}|muerte a los {g}|los {g} apestan|los {g} no saben pensar|las {g} a la cocina|no contrates a {g}, son {x}|sin los {g} todo iría mejor|esos {g} son {x}|los {g} no caben en {pl}",
        "sexual": "quiero {f}te|te quiero {f}|quiero {f} tus {p}|quiero verte {sx}|enséñame las {p}|enseña el {p}|mándame {pn}|tus {p} me ponen|bonitas {p}|{w} {sx}|{w} {sx} cerca de ti|{pn} gratis|{pn} con {w} {sx}|ven a mi cama|acuéstate conmigo|sueño con tus {p}|déjame {f} tus {p}|ella {act}|él {act}|ella {act} y él {act}|desnúdate|siéntate en mis rodillas|estoy {sx}|qué ganas de {f}te",
    },
}
#: Harmless sentences made of the same words: of technology, of groups in passing, of harsh words about things, of reports on moderation.
HARMLESS = {
    "en": "{oath}, the {thing} failed again|{oath}, i broke the {thing}|{oath} this {thing}|oh {oath}, sorry everyone|{oath}, sorry all|{oath}! forgot the {thing}|what the {oath} is this {thing}|how the {oath} does the {thing} work|the {thing} is full of {oath}|{oath}ing {thing}|holy {oath}, the {thing} is fast|no {oath}, the {thing} is {bad}|i am an idiot, i broke the {thing}|my {bad} {thing} broke again|silly me, wrong {thing}|{kill} the {thing}|please {kill} the stuck {thing}|the {thing} was {killed} by the {thing}|the parent {killed} its child {thing}|a dead {thing} holds the {thing}|the {thing} died and was restarted|{bad} {thing}|this {thing} is {bad}|what a {bad} {thing}|the {thing} is {bad} and the {thing} is worse|whoever wrote this {thing} made a {bad} mess|i hate this {thing}|this {thing} sucks|damn {thing}|the {thing} is a piece of crap|shut down the {thing}|shut up the noisy {thing}|master and slave {thing}|the {thing} hangs|hang on, the {thing} is slow|{group} and {group} are counted in the table|{group} can sign up for the {thing}|the survey asks {group} about the {thing}|a page for {group} was added|support for {group} in the {thing}|our {group} colleagues wrote the {thing}|the holiday of {group} is in the calendar|a moderator removed a comment that insulted {group}|the policy bans threats, porn and hate against {group}|an account was banned for calling someone an {i}|the filter flags words such as {i}|report abusive comments about {group}|the word {i} is on the blocklist|the {thing} exposes a naked {thing}|strip the {thing}|the form has a column for sex|penetration test of the {thing}|the {thing} injects code|abort the {thing}|execute the {thing}|the attacker can hijack the {thing}|fork bomb in the {thing}|dirty reads in the {thing}|the {thing} is dumb but works|foolproof {thing}|you should break the {thing} into parts|you can hit the {thing} with requests|you will break the {thing}|i will cut the {thing}|we beat the {thing} by ten percent|burn the {thing} into the image|i will shoot you a message|you are right about the {thing}|you are blocking the {thing}|your {thing} is wrong|nobody uses this {thing}|everyone hates the {thing}|the {thing} smells|get rid of the {thing}|throw out the old {thing}|we should exterminate this bug|ban the {thing}|the {thing} leaks|hot {thing}|touch the {thing}|show me the {thing}|send me the {thing}|i want to see the {thing}",
    "de": "{oath}, der {thing} ist kaputt|{oath}, ich habe den {thing} vergessen|so ein {oath} {thing}|was für ein {oath}|{oath}er {thing}|der {thing} wurde beendet|töte den {thing}|der Kindprozess {thing} wird getötet|der {thing} ist {bad}|so ein {bad}er {thing}|dieser {thing} ist Mist|{group} und {group} werden gezählt|{group} können sich anmelden|eine Seite für {group}|ein Moderator löschte eine Beleidigung gegen {group}|die Regeln verbieten Drohungen gegen {group}|nackter {thing} ohne Hülle|der {thing} hängt|schick mir den {thing}|zeig mir den {thing}|der {thing} stinkt|ich hasse den {thing}|niemand mag den {thing}|wirf den {thing} raus|der {thing} gehört entfernt|das Wort {i} wird gefiltert",
    "fr": "{oath}, le {thing} est cassé|{oath} de {thing}|{oath}, j'ai oublié le {thing}|quel {oath} de {thing}|le {thing} doit passer|le {thing} est mort|le {thing} est {bad}|quel {thing} {bad}|ce {thing} est nul|les {group} et les {group} sont comptés|les {group} peuvent s'inscrire|une page pour les {group}|un modérateur a supprimé une insulte contre les {group}|la charte interdit les menaces contre les {group}|le {thing} nu|envoie-moi le {thing}|montre-moi le {thing}|je déteste ce {thing}|personne n'aime ce {thing}|il faut virer le {thing}|le {thing} plante|le mot {i} est filtré",
    "es": "{oath}, el {thing} falla|{oath} de {thing}|{oath}, olvidé el {thing}|qué {oath} de {thing}|el {thing} debe pasar|el {thing} murió|el {thing} es {bad}|qué {thing} tan {bad}|este {thing} es una basura|los {group} y los {group} se cuentan|los {group} pueden registrarse|una página para {group}|un moderador borró un insulto contra los {group}|las normas prohíben amenazas contra los {group}|el {thing} desnudo|mándame el {thing}|enséñame el {thing}|odio este {thing}|nadie quiere este {thing}|hay que echar el {thing}|el {thing} se cuelga|la palabra {i} se filtra",
}
NEUTRAL = {
    "en": {"oath": "crap|shit|damn|fuck|hell|goddamn it|bloody hell|bullshit", "kill": "kill|stop|terminate|abort|reap|nuke|shoot down|execute|drop|purge", "killed": "killed|shot|terminated|orphaned|adopted|reaped|executed|buried", "bad": "stupid|dumb|ugly|awful|terrible|broken|crappy|useless|worthless|pathetic|nasty|dirty|garbage|horrible|disgusting|brain-dead|rotten", "thing": "process|thread|job|build|code|hack|function|test|server|pod|script|cache|query|bug|commit|design|log|file|host|worker|compiler|service|{n}|{n}|{n}", "group": "women|men|foreigners|immigrants|refugees|Muslims|Jews|Christians|gays|old people|disabled people|trans people|blacks|Poles|{N}|the {N}"},
    "de": {"oath": "Mist|Scheiße|verdammt|Verdammter|Scheiß|verflixt", "bad": "dumm|blöd|hässlich|furchtbar|kaputt|nutzlos|mies|elend|schlecht", "thing": "Prozess|Code|Build|Test|Server|Job|Fehler|Hack|Cache|{n}|{n}", "group": "Frauen|Männer|Ausländer|Flüchtlinge|Muslime|Juden|Behinderte|Polen|{N}|Schwule"},
    "fr": {"oath": "merde|putain|zut|bordel|fichu", "bad": "nul|moche|stupide|affreux|cassé|inutile|pourri|minable", "thing": "processus|code|build|test|serveur|job|bug|cache|{n}|{n}", "group": "femmes|hommes|étrangers|réfugiés|musulmans|juifs|handicapés|{N}|immigrés"},
    "es": {"oath": "mierda|joder|coño|maldita sea|puñetas|porquería", "bad": "tonto|feo|horrible|roto|inútil|malo|estúpido|asqueroso", "thing": "proceso|código|build|test|servidor|job|error|caché|{n}|{n}", "group": "mujeres|hombres|extranjeros|refugiados|musulmanes|judíos|discapacitados|{N}|inmigrantes"},
}
KINDS = ("insult", "threat", "hate", "sexual")


def _fill(frame: str, pools: dict[str, str], rng: random.Random) -> str:
    def one(m: re.Match) -> str:
        if m[1] == "n":
            return name(rng)
        if m[1] == "N":
            return name(rng).capitalize() + rng.choice(["s", "ists", "ians", "ers", "ites", "en", "is"])
        return rng.choice(pools[m[1]].split("|"))

    for _ in range(3):
        frame = re.sub(r"\{(\w+)\}", one, frame)
    return frame[0].upper() + frame[1:] + rng.choice([".", "!", "", ",", "...", "!!"])


def compose(rng: random.Random, lang: str | None = None, kind: str | None = None) -> str:
    """One abusive sentence, or two."""
    lang = lang or rng.choices(list(FRAMES), [5, 3, 3, 3])[0]
    frames = FRAMES[lang][kind or rng.choice(KINDS)].split("|")
    return " ".join(_fill(rng.choice(frames), WORDS[lang], rng) for _ in range(rng.choice([1, 1, 1, 2])))


def compose_harmless(rng: random.Random) -> str:
    lang = rng.choices(list(HARMLESS), [5, 2, 2, 2])[0]
    pools = NEUTRAL[lang] | {"i": WORDS[lang]["i"]}
    return " ".join(_fill(rng.choice(HARMLESS[lang].split("|")), pools, rng) for _ in range(rng.choice([1, 1, 2])))


def name(rng: random.Random) -> str:
    """An invented word."""
    s = "".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "", "l", "n", "r"]) for _ in range(rng.randint(2, 3)))
    return s if rng.random() < 0.5 else s.capitalize()


def disguise(s: str, rng: random.Random) -> str:
    """Capitals, or one or two longer words spaced, dotted, starred or with digits for letters."""
    if rng.random() < 0.12:
        s = s.upper()
    if rng.random() < 0.6:
        return s
    w = s.split(" ")
    long = [i for i, x in enumerate(w) if sum(c.isalpha() for c in x) >= 4]
    for i in rng.sample(long, min(len(long), rng.choice([1, 1, 2]))):
        m = re.match(r"(\W*)(.*?)(\W*)$", w[i], re.S)
        a, x, b = m.groups()
        if not x or not x.isalpha():
            continue
        how = rng.randrange(5)
        if how == 0:
            x = rng.choice([" ", ".", "-"]).join(x)
        elif how == 1:
            x = x[0] + "*" * (len(x) - 2) + x[-1]
        elif how == 2:
            swap = {"o": "0", "i": "1", "e": "3", "a": "4", "s": rng.choice("5$"), "t": "7"}
            at = [k for k, c in enumerate(x) if c.lower() in swap]
            for k in rng.sample(at, min(len(at), rng.randint(1, 2))):
                x = x[:k] + swap[x[k].lower()] + x[k + 1 :]
        elif how == 3:
            k = rng.randrange(1, len(x) - 1)
            x = x[:k] + "*" + x[k + 1 :]
        elif i + 1 < len(w):
            b += "\0"  # joined to the next word
        w[i] = a + x + b
    return " ".join(w).replace("\0 ", "").replace("\0", "")


def spliced(a: str, b: str) -> str:
    """The head of one word and the tail of another."""
    return a[: (len(a) + 1) // 2] + b[len(b) // 2 :]


def varied(words: list[str], rng: random.Random) -> list[str]:
    """Harmless words with some replaced by invented ones, plain or joined to identifiers, which corpora are full of."""
    if rng.random() < 0.35:
        return words
    out = []
    stray = rng.random() < 0.15
    for w in words:
        if stray and rng.random() < 0.2:
            out += rng.choice([["a", "b", "c"], [rng.choice("abcdefghijklmnopqrstuvwxyz")], ["x" * rng.randint(2, 30)], [name(rng).lower()]])
        if w.isalpha() and len(w) > 3 and rng.random() < 0.3:
            out.append(rng.choice([name(rng).lower(), name(rng).lower() + rng.choice('aeiou'), w + name(rng).lower(), w + rng.choice(words), name(rng).lower() + name(rng).lower(), spliced(w, rng.choice(words)), spliced(w, name(rng).lower())]))
        else:
            out.append(w)
    return out[: A.WINDOW]


def params(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = 2 * A.DIM, A.HIDDEN
    n = lambda *s, k=None: (rng.standard_normal(s) * (k or 1 / np.sqrt(s[0]))).astype(np.float32)
    p = {"word": n(A.BUCKETS + 1, A.DIM, k=0.1), "char": n(A.BUCKETS, A.DIM, k=0.2), "u": n(2 * h), "o": n(2 * h), "ob": np.zeros(1, np.float32)}
    for s in "fb":
        p |= {s + "x": n(d, 3 * h), s + "b": np.zeros(3 * h, np.float32), s + "h": n(h, 3 * h), s + "n": np.zeros(h, np.float32)}
    return p


def gradients(p: dict[str, np.ndarray], batch: list[list[str]], y: np.ndarray, drop: np.random.Generator, owner: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of a batch of windows (lists of words), by hand."""
    H, n = A.HIDDEN, len(batch)
    T = max(map(len, batch))
    mask = np.zeros((n, T), np.float32)
    wid = np.zeros((n, T), np.int64)
    grams: list[int] = []
    at: list[int] = []
    for i, b in enumerate(batch):
        mask[i, : len(b)] = 1
        for t, w in enumerate(b):
            k, g = A.hashed(w)
            wid[i, t] = k % A.BUCKETS if owner is None or owner[k % A.BUCKETS] == k else A.BUCKETS
            grams += g
            at += [i * T + t] * len(g)
    keep = (drop.random((n, T, 1)) > 0.25).astype(np.float32)  # words left out at times, so that trigrams learn
    at_, grams_ = np.array(at), np.array(grams)
    count = np.maximum(np.bincount(at_, minlength=n * T), 1).astype(np.float32)[:, None]
    mean = np.zeros((n * T, A.DIM), np.float32)
    np.add.at(mean, at_, p["char"][grams_])
    mean /= count
    x = np.concatenate([p["word"][wid] * keep, mean.reshape(n, T, A.DIM)], axis=2)
    saved, outs = {}, []
    for s in "fb":
        gx = x @ p[s + "x"] + p[s + "b"]
        h = np.zeros((n, H), np.float32)
        out, tape = np.zeros((n, T, H), np.float32), {}
        for t in range(T) if s == "f" else range(T - 1, -1, -1):
            gh = h @ p[s + "h"]
            r = A.gate((gx[:, t, :H] + gh[:, :H]) / 4 + 0.5)
            z = A.gate((gx[:, t, H : 2 * H] + gh[:, H : 2 * H]) / 4 + 0.5)
            q = gh[:, 2 * H :] + p[s + "n"]
            c = A.soft(gx[:, t, 2 * H :] + r * q)
            tape[t] = (h, r, z, q, c)
            h = h + mask[:, t : t + 1] * z * (c - h)
            out[:, t] = h
        saved[s] = tape
        outs.append(out)
    hs = np.concatenate(outs, axis=2)
    e = hs @ p["u"] + (mask - 1) * 1e9
    w = np.exp(e - e.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    pooled = (hs * w[:, :, None]).sum(axis=1)
    prob = A._sigmoid(pooled @ p["o"] + p["ob"])
    loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = ((prob - y) / n).astype(np.float32)
    g["ob"][0] = d.sum()
    g["o"] = pooled.T @ d
    dp = d[:, None] * p["o"]
    dw = (hs * dp[:, None, :]).sum(axis=2)
    de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
    g["u"] = np.einsum("nth,nt->h", hs, de)
    dh_all = w[:, :, None] * dp[:, None, :] + de[:, :, None] * p["u"]
    dx = np.zeros_like(x)
    for j, s in enumerate("fb"):
        dh_out = dh_all[:, :, j * H : (j + 1) * H]
        dh = np.zeros((n, H), np.float32)
        for t in range(T - 1, -1, -1) if s == "f" else range(T):
            h, r, z, q, c = saved[s][t]
            dh = dh + dh_out[:, t]
            m = mask[:, t : t + 1]
            dz = dh * m * (c - h)
            dc = dh * m * z * (1 - np.abs(c)) ** 2
            dr = dc * q
            part = np.concatenate([dr * ((r > 0) & (r < 1)) / 4, dz * ((z > 0) & (z < 1)) / 4, dc], axis=1)
            part_h = np.concatenate([part[:, : 2 * H], dc * r], axis=1)
            g[s + "x"] += x[:, t].T @ part
            g[s + "b"] += part.sum(axis=0)
            g[s + "h"] += h.T @ part_h
            g[s + "n"] += (dc * r).sum(axis=0)
            dx[:, t] += part @ p[s + "x"].T
            dh = dh * (1 - m * z) + part_h @ p[s + "h"].T
    np.add.at(g["word"], wid.reshape(-1), (dx[:, :, : A.DIM] * keep * mask[:, :, None]).reshape(-1, A.DIM))
    np.add.at(g["char"], grams_, (dx[:, :, A.DIM :].reshape(n * T, A.DIM) / count)[at_])
    return loss, g


def owners(sentences) -> np.ndarray:
    """For each bucket the hash of its most frequent word, of those that occur three times or more, else -1."""
    seen: dict[int, int] = defaultdict(int)
    for words in sentences:
        for w in words:
            seen[A.hashed(w)[0]] += 1
    out = np.full(A.BUCKETS, -1, np.int64)
    for h, n in sorted(seen.items(), key=lambda x: (x[1], x[0])):
        if n >= 3:
            out[h % A.BUCKETS] = h
    return out


def fit(pos, neg, seed: int, owner: np.ndarray, epochs: int = EPOCHS, p: dict | None = None) -> dict[str, np.ndarray]:
    """Adam over mixed batches; pos and neg give the windows of an epoch."""
    rng = np.random.default_rng(seed)
    p = p or params(rng)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        data = [(w, 1.0) for w in pos(epoch)] + [(w, 0.0) for w in neg(epoch)]
        order = rng.permutation(len(data))
        total = 0.0
        for a in range(0, len(order), BATCH):
            part = [data[i] for i in order[a : a + BATCH]]
            loss, g = gradients(p, [w for w, _ in part], np.array([y for _, y in part], np.float32), rng, owner)
            total += loss * len(part)
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] ** 2 - m2[k])
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: {len(data)} windows, loss {total / len(data):.4f}", flush=True)
    return p


def crop(sentence: list[str], context: list[str], rng: random.Random) -> list[str]:
    """A window with most of the sentence, in the midst of other words, as the scorer may meet it."""
    n = A.WINDOW
    if rng.random() < 0.15 or not context:
        return sentence[:n]
    k = rng.randrange(max(1, len(context) - n))
    before, after = context[k : k + n], context[k + n : k + 2 * n]
    whole = before + sentence + after
    least = min(len(sentence), n - 3)
    lo, hi = max(0, len(before) - n + least), len(before) + max(0, len(sentence) - least)
    a = rng.randint(min(lo, hi), max(lo, hi))
    return whole[a : a + n]


def train(texts: list[str], marks: list[float], seed: int = 7) -> dict[str, np.ndarray]:
    """The weights."""
    rng = random.Random(seed)
    good = [A.tokens(t) for t, m in zip(texts, marks) if m < 0.5 and t]
    bad = [A.tokens(t) for t, m in zip(texts, marks) if m >= 0.5 and t]
    wins = [t[s : s + A.WINDOW] for t in good for s in A.windows(len(t))]
    contexts = [t for t in good if len(t) > 3 * A.WINDOW]
    marked: list[list[str]] = []
    hard: list[list[str]] = []

    def pos(epoch: int):
        made = [crop(A.tokens(disguise(compose(rng), rng)), rng.choice(contexts), rng) for _ in range(12_000)]
        return made + [rng.choice(marked) for _ in range(1500 if marked else 0)]

    def neg(epoch: int):
        some = [varied(w, rng) for w in rng.sample(wins, min(len(wins), 26_000))]
        short = [w[a : a + rng.randint(1, 6)] for w in rng.sample(some, min(len(some), 2000)) for a in [rng.randrange(max(1, len(w) - 3))]]
        made = [crop(A.tokens(compose_harmless(rng)), rng.choice(contexts), rng) for _ in range(6000)]
        return some + short + made + rng.sample(hard, min(len(hard), 6000))

    def scored(net: A.Network, docs: list[list[str]]):
        s, of = A.Scorer(net).windows_of([" ".join(t) for t in docs])
        return s, of, [(d, int(a)) for d, t in enumerate(docs) for a in A.windows(len(t))]

    owner = owners(good + bad + [A.tokens(f(rng)) for _ in range(15_000) for f in (compose, compose_harmless)])

    def network(p: dict) -> A.Network:
        return A.Network(p | {"owner": owner})

    p = fit(pos, neg, seed, owner)
    for again in range(2):
        s, _, every = scored(network(p), bad)
        marked = [bad[d][a : a + A.WINDOW] for x, (d, a) in zip(s, every) if x > 0.6]
        s, of, every = scored(network(p), good)
        top = np.zeros(len(good), np.float32)
        np.maximum.at(top, of, s)
        doubtful = set(np.flatnonzero(top > 0.97).tolist())  # marked harmless, read as abusive
        hard = [good[d][a : a + A.WINDOW] for x, (d, a) in zip(s, every) if x > 0.02 and d not in doubtful]
        print(f"{len(marked)} marked windows, {len(hard)} hard ones, {len(doubtful)} of {len(good)} documents left out", flush=True)
        p = fit(pos, neg, seed + 1 + again, owner, 5, p)
    return p | {"owner": owner}


def best_threshold(net: A.Network, harmless: list[str], share: float = 0.05, seed: int = 3) -> float:
    """The best balance (F1) where ``share`` of the texts are abusive, on harmless texts not trained on, as they are and with a composed passage in their midst."""
    rng = random.Random(seed)
    with_passage = []
    for t in harmless * 4:
        w = t.split(" ")
        k = rng.randrange(len(w) + 1)
        with_passage.append(" ".join(w[:k] + [disguise(compose(rng), rng)] + w[k:]))
    scorer = A.Scorer(net)
    no, yes = scorer.scores(harmless), scorer.scores(with_passage)

    def f1(at: float) -> float:
        hit, wrong = share * (yes >= at).mean(), (1 - share) * (no >= at).mean()
        return 2 * hit / (hit + wrong + share)

    return max((x / 1000 for x in range(500, 1000, 5)), key=f1)


def labelled(sf_dir: str) -> dict[int, tuple[str, float]]:
    """Text and mean mark of the labelled documents, of at most MOST_LABELS labels."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    votes: dict[int, list[float]] = defaultdict(list)
    for r in pq.read_table(f"{sf_dir}/labels.parquet").slice(0, MOST_LABELS).to_pylist():
        if r["toxic"] is not None:
            votes[r["doc_id"]].append(r["toxic"])
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    docs = docs.filter(pc.is_in(docs["doc_id"], value_set=pa.array(list(votes), docs.schema.field("doc_id").type)))
    return {r["doc_id"]: (r["text"], float(np.mean(votes[r["doc_id"]]))) for r in docs.to_pylist() if r["text"]}


def main(sf_dir: str) -> None:
    rows = labelled(sf_dir)
    part = {k: sorted(i for i in rows if i % HELD_OUT in k) for k in ((0,), (1,), (2, 3, 4))}
    p = train([rows[i][0] for i in part[2, 3, 4]], [rows[i][1] for i in part[2, 3, 4]])
    p["threshold"] = np.float32(best_threshold(A.Network(p), [rows[i][0] for i in part[1,] if rows[i][1] < 0.5]))
    np.savez_compressed(A.WEIGHTS, **{k: v.astype({"threshold": np.float32, "owner": np.int64}.get(k, np.float16)) for k, v in p.items()})
    net = A.Network.load()
    held = part[0,]
    flagged = A.Scorer(net).scores([rows[i][0] for i in held]) >= net.threshold
    bad = np.array([rows[i][1] >= 0.5 for i in held])
    print(f"threshold {net.threshold:.3f}; held out: {(flagged & bad).sum()} of {bad.sum()} marked abusive flagged, {(flagged & ~bad).sum()} of {(~bad).sum()} marked harmless")


if __name__ == "__main__":
    main(sys.argv[1])
