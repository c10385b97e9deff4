"""Personal information inside free text.

Regular expressions propose spans of each kind; validators (digit groups and checks such
as Luhn, mod 97 and the letter of mod 23) confirm or reject them; the words and marks
around a span move its score, and spans that reach THRESHOLD count. Overlaps go to the
kind earlier in KINDS, then to the longer span.

Defined results: null and empty texts have no spans; copies of a row have the same ones;
text between the spans stays as it is, byte for byte; of JSON arguments the decoded values
count, and masking re-encodes only strings that changed; what isn't JSON (cut off, say) is
treated as text with the escapes decoded where they are whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "address", "id_number", "phone", "name")
THRESHOLD = 0.5

_UP, _LOW = "A-ZÀ-ÖØ-ÞŁŚŞŠŽ", "a-zß-öø-ÿłśşšžğı"
#: A capitalised or upper-case word of a name, hyphens and apostrophes in.
_W = rf"(?:[{_UP}][{_LOW}]+(?:[-'’][{_UP}]?[{_LOW}]+)*|[{_UP}]['’][{_UP}][{_LOW}]+|(?:Mc|Mac|De|Di|Van)[{_UP}][{_LOW}]+|[{_UP}]{{2,}}(?:[-'’][{_UP}]{{2,}})*)"
_L = rf"[{_UP}{_LOW}]"

# ---------------------------------------------------------------- email

_LOCAL = rf"[\w.+'-]*\w"
EMAIL = re.compile(
    rf"(?<![\w.+-])(?P<local>{_LOCAL}(?:\s(?:dot|punto|point|punkt)\s{_LOCAL})*)"
    r"(?P<at>@|%40|&#64;|&commat;|=40|\s?[\(\[\{<]\s?(?:at|@|arroba|ät)\s?[\)\]\}>]\s?|\s(?:at|arroba|arobase|ät)\s|\s@\s)"
    r"(?P<host>[^\W_](?:[\w-]*\w)?(?:(?:\.|\s?[\(\[]\s?(?:dot|\.|punkt|punto|point)\s?[\)\]]\s?|\s(?:dot|punto|punkt|point)\s)[^\W_](?:[\w-]*\w)?)+)",
    re.I,
)
#: What every address has; the full pattern runs only around it.
_AT = re.compile(r"@|%40|=40|&#64;|&commat;|[\(\[\{<]\s?(?:at|arroba|ät)\b|\s(?:at|arroba|arobase|ät)\s(?=\S+?\s?(?:[\(\[]\s?\.|[\(\[]?\s?(?:dot|punkt|punto|point)\b))", re.I)
_AT_WORDS = ("@", "%40", "=40", "&#64;", "&commat;")
#: Of lower-cased texts without these, an address has its at in brackets or a dot written out.
_AT_WRITTEN = re.compile(r"[\(\[\{<]\s?(?:at|arroba|ät)\b|[\(\[]\s?\.|[\s\(\[](?:dot|punkt|punto|point)[\s\)\]]")


def _may_hold_email(t: str) -> bool:
    low = t.lower()
    return any(w in low for w in _AT_WORDS) or _AT_WRITTEN.search(low) is not None


def _around(t: str, marks: Iterable[re.Match], left: int, right: int) -> Iterable[tuple[int, int]]:
    """Windows around the marks, those that overlap joined."""
    a = b = -1
    for m in marks:
        x, y = max(0, m.start() - left), m.end() + right
        if x <= b:
            b = y
        else:
            if b >= 0:
                yield a, b
            a, b = x, y
    if b >= 0:
        yield a, b


def _all(p: re.Pattern, t: str, windows: Iterable[tuple[int, int]]) -> Iterable[re.Match]:
    for a, b in windows:
        yield from p.finditer(t, a, b)


def _emails(t: str) -> Iterable[tuple[int, int, float]]:
    for m in _all(EMAIL, t, _around(t, _AT.finditer(t), 100, 120)):
        at, host, local = m["at"].strip().lower(), m["host"], m["local"]
        last = re.split(r"[.\s\)\]]+", host)[-1]
        score = 0.7
        if at in ("at", "arroba", "arobase", "ät"):
            # written out: the host must have its dots written out too
            score = 0.7 if re.search(r"\sdot\s|\spunkt\s|\spunto\s|\spoint\s|[\(\[]", host, re.I) else 0.2
        if not re.fullmatch(r"[^\W\d_]{2,}", last):
            score -= 0.6  # a version, an address in digits
        after = t[m.end() : m.end() + 2]
        if local == "git" or (after[:1] in (":", "/") and after[1:] and not after[1:].isspace()):
            score -= 0.6  # a remote
        if t[max(0, m.start() - 3) : m.start()] == "://":
            score -= 0.6
        start = m.start()
        if " " in local:  # "local dot part at": no words before the address
            start += len(local) - len(re.search(r"\S+(?:\s(?:dot|punto|point|punkt)\s\S+)*$", local, re.I).group())
        yield start, m.end(), score


# ---------------------------------------------------------------- phone

_B, _E = r"(?<![\w.+/=-])", r"(?![\w/]|[.-]\w)"
PHONE = re.compile(
    "|".join(
        [
            rf"{_B}\+\d{{1,3}}(?:[ .-]?\(0\))?(?:[ .-]?\(?\d{{1,5}}\)?){{2,6}}{_E}",
            rf"{_B}00[1-9]\d(?:[ .-]?\d{{1,5}}){{2,5}}{_E}",
            rf"(?<![\w(])\([2-9]\d\d\)[ -]?\d{{3}}[ .-]\d{{4}}{_E}",
            rf"{_B}(?:1[ .-])?[2-9]\d\d([.-])[2-9]\d\d\1\d{{4}}{_E}",
            rf"{_B}07\d{{3}}[ -]?\d{{3}}[ -]?\d{{3}}{_E}",
            rf"{_B}0[1-9](?:[ .]\d\d){{4}}{_E}",
            rf"{_B}0\d{{2,4}}[ /-]\d{{5,8}}{_E}",
            rf"{_B}0\d{{2,4}}([ -])\d{{3,4}}\2\d{{4}}{_E}",
            rf"{_B}[6-9]\d\d[ ]\d{{3}}[ ]\d{{3}}{_E}",
            rf"{_B}1[2-9]\d\d[2-9]\d{{6}}{_E}",
        ]
    )
)
#: Runs of digits and what divides them; phone numbers are looked for only there.
_RUN = re.compile(r"\d[\d .()/+-]{5,}\d")
_PHONE_WORDS = re.compile(r"(?i)\b(?:t[eé]l(?:[eé]?fon[eo]?|ephone)?|phone\w*|mobile?|móvil|portable|cell(?:phone|ular)?|call\w*|dial\w*|ring|text(?:ed)?|sms|fax|msisdn|nummer|number|(?:rück|an)?ruf\w*|handy|numéro|número|appel\w*|joindre|ll[aá]m\w+|marc\w+|whatsapp|contact\w*|reach\w*|erreichbar)\b")
#: Verbs that follow a number in German word order.
_PHONE_AFTER = re.compile(r"(?i)\W{1,3}(?:\w+\s)?(?:(?:an|zurück)?(?:zu)?rufen|wählen|erreichbar)\b")


def _phones(t: str) -> Iterable[tuple[int, int, float]]:
    for m in _all(PHONE, t, _around(t, _RUN.finditer(t), 12, 16)):
        s = m.group()
        n = sum(c.isdigit() for c in s)
        score = 0.6 if 8 <= n <= 15 else 0.0
        bare = s.isdigit()
        if bare:
            score -= 0.3
        if re.fullmatch(r"[6-9]\d\d \d{3} \d{3}", s):
            score -= 0.3
        if _PHONE_WORDS.search(t[max(0, m.start() - 32) : m.start()]) or _PHONE_AFTER.match(t, m.end(), m.end() + 32):
            score += 0.3
        elif bare and _cell(t, m.start(), m.end()):
            score += 0.3
        yield m.start(), m.end(), score


# ---------------------------------------------------------------- identity numbers

ID = re.compile(
    "|".join(
        [
            rf"(?P<ssn>{_B}\d{{3}}([ -])\d\d\2\d{{4}}{_E})",
            rf"(?P<nino>(?<!\w)[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-D](?!\w))",
            rf"(?P<dni>(?<!\w)\d{{8}}-?[A-HJ-NP-TV-Z](?!\w))",
            rf"(?P<nie>(?<!\w)[XYZ]-?\d{{7}}-?[A-HJ-NP-TV-Z](?!\w))",
            rf"(?P<pass>(?<![\w/-])(?:[A-Z]{{1,2}}\d{{6,8}}|[A-Z]\d{{7}}[A-Z0-9]|\d{{2}}[A-Z]{{2}}\d{{5}}|[CFGHJKLMNPRTVWXYZ0-9]{{9,10}}|\d{{9}})(?![\w/-]))",
            rf"(?P<insee>(?<![\w-])[1278] ?\d\d ?(?:0[1-9]|1[0-2]|[2-9]\d) ?\d[\dAB] ?\d{{3}} ?\d{{3}} ?\d\d(?![\w-]))",
            rf"(?P<steuer>(?<![\w-])[1-9]\d(?: ?\d{{3}}){{3}}(?![\w-]))",
            rf"(?P<sin>(?<![\w-])\d{{3}}[ -]\d{{3}}[ -]\d{{3}}(?![\w-]))",
        ]
    )
)
_ID_WORDS = re.compile(
    r"(?i)(?:\bssn|social security|\bnino\b|\bni number|national insurance|pass(?:port|eport|nummer|aporte)?\b|reisepass\w*|\b\w*ausweis\w*|\bdni\b|\bnie\b|\bnif\b|\bcni\b|carte d.identit|tax[ -]?id|\btin\b|\bitin\b|steuer\w*|\bnir\b|s[ée]curit[ée] sociale|seguridad social|sozialversicherung\w*|id ?card|identity card|id check|identi\w+ (?:no|number|document))[\s\w.:=\"'#-]{0,12}$"
)
#: What every identity number has: six digits, or characters between them, in a row, or nine capitals and digits.
_ID_RUN = re.compile(r"\d[\d .()/+-]{4,}\d|(?<!\w)(?=[A-Z]*\d)[A-Z0-9]{9}")
_ID_FIELD = re.compile(r"(?i)(?:doc|ref|ssn|id_number|passport|tax_?id|national_?id|note)\W{1,4}$")
#: Letters of the remainders of mod 23. Fixed values.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(number: str) -> bool:
    """The key of the last two digits complements the rest to 97."""
    head = number[:-2].replace("2A", "19").replace("2B", "18")
    return head.isdigit() and 97 - int(head) % 97 == int(number[-2:])


def mod11_10(digits: str) -> bool:
    p = 10
    for c in digits[:-1]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[-1])


def _valid(kind: str, s: str) -> float:
    """What the form itself is worth: confirmed by a check, plausible, or refuted (below 0)."""
    x = re.sub(r"[ -]", "", s)
    if kind == "ssn":
        a, b, c = x[:3], x[3:5], x[5:]
        return -1.0 if a in ("000", "666") or b == "00" or c == "0000" else 0.5 if "-" in s else 0.2
    if kind == "nino":
        return 0.5
    if kind in ("dni", "nie"):
        n = x.translate(str.maketrans("XYZ", "012")) if kind == "nie" else x
        return 0.6 if _DNI[int(n[:-1]) % 23] == x[-1] else 0.1
    if kind == "insee":
        return 0.6 if mod97(x) else 0.0
    if kind == "steuer":
        return 0.3 if mod11_10(x) else 0.0
    if kind == "sin":
        return 0.2 if luhn(x) else 0.0
    return 0.1 if any(c.isdigit() for c in x) else -1.0


def _ids(t: str) -> Iterable[tuple[int, int, float]]:
    for m in _all(ID, t, _around(t, _ID_RUN.finditer(t), 12, 16)):
        kind, s = m.lastgroup, m.group()
        if kind is None:
            kind = next(k for k, v in m.groupdict().items() if v)
        score = _valid(kind, s)
        if score < 0:
            continue
        near = t[max(0, m.start() - 40) : m.start()]
        w = _ID_WORDS.search(near)
        start = m.start()
        if w:
            score += 0.5
            start -= len(near) - w.start()
        elif kind in ("nino", "dni", "nie") and _ID_FIELD.search(near):
            score += 0.2
        yield start, m.end(), score


# ---------------------------------------------------------------- address

_NO = r"\d{1,4}(?:\s?[a-zA-Z])?"
_TYPE_EN = r"(?:Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Ter|Close|Crescent|Cres|Row|Hill|Gardens|Grove|Mews|Parkway|Pkwy|Highway|Hwy|Alley|Walk|Wharf|Quay)"
_TYPE_FR = r"(?:rue|avenue|boulevard|bd|chemin|place|impasse|quai|allée|route|passage|square|cours|sentier|venelle|ruelle|faubourg|esplanade|promenade|montée)"
_TYPE_ES = r"(?:C/|Calle|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Carretera|Ctra\.?|Ronda|Travesía|Callejón|Cuesta|Glorieta|Rambla)"
_TYPE_DE = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig|pfad|chaussee|markt|zeile|stieg|graben|promenade|wall)"
_TAIL = rf"(?:,?\s(?:Apt|Apartment|Unit|Suite|Flat|Floor|Ste)\.?\s?#?\w{{1,5}})?(?:,\s\d{{1,2}}[ºª](?:\s?[A-Z])?)?(?:,\s\d{{4,5}}\s{_W}(?:[ -]{_W})?|,\s(?:{_W})(?=$|[\s,.;|\"<]))?"
ADDRESS = [
    re.compile(rf"(?<![\w./#-])\d{{1,5}}[a-zA-Z]?\s(?:{_W}\s){{1,4}}{_TYPE_EN}\b(?![\w/]){_TAIL}"),
    re.compile(rf"(?i:(?<![\w./#-])\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s{_TYPE_FR}\s(?:de\s|du\s|des\s|d['’]|de\sla\s|de\sl['’]|la\s|le\s|les\s)*)(?:{_L}[\w'’-]+)(?:\s(?:(?:de|du|des|la|le|les|en|sur|aux?)\s)*{_W})*{_TAIL}"),
    re.compile(rf"(?<![\w/]){_TYPE_ES}\s(?:(?:de|del|la|las|los|el)\s)*{_W}(?:\s(?:(?:de|del|la|las|los|el|y)\s)*{_W})*,?\s(?:n\.?º\s?)?{_NO}(?![\w/]){_TAIL}"),
    re.compile(rf"(?<![\w/])(?:{_W}[\s-]){{0,2}}[{_UP}][{_LOW}]+{_TYPE_DE}\s{_NO}(?![\w/]){_TAIL}"),
    re.compile(rf"(?<![\w/])(?:[{_UP}]{{3,}}(?:STRASSE|STRAßE|STR\.|GASSE|WEG|ALLEE|PLATZ|RING|DAMM|UFER))\s{_NO}(?![\w/])"),
    re.compile(rf"(?<![\w/])(?:Am|An\sder|An\sden|Auf\sder|Auf\sdem|Im|In\sder|Zum|Zur|Unter\sden|Hinter\sder|Hinter\sdem|Beim)\s{_W}(?:\s{_W})?\s{_NO}(?![\w/]|[.:]\d){_TAIL}"),
    re.compile(rf"(?i:(?<![\w/])(?:rue|boulevard|impasse|chemin)\s(?:de\s|du\s|des\s|d['’]|la\s|le\s|les\s)*){_W}(?:[\s-]{_W})*,\s(?:n°\s?)?\d{{1,4}}(?![\w/])"),
]
#: Words before an address: field labels, verbs of living, sending and going, prepositions of place.
_ADDRESS_WORDS = re.compile(r"(?i)(?:\b(?:addr\w*|adress\w*|anschrift|direcci[oó]n|domicilio|street|line ?\d|location|residence|billing|shipping|ship\w*|deliver\w*|sen[dt]\w*|mail(?:ed)?|post(?:ed)?|liefer\w*|versand|livr\w+|expédi\w+|env[ií]\w*|entreg\w*|li[vf]e[sd]?|living|resid\w+|moved|wohn\w*|habit\w+|demeur\w+|viv[eo]n?|reside\w*)(?:\s(?:it|them|is|ist|est|es))?(?:\s(?:to|at|in|on|nach|an|au|à|a|en))?|\b(?:to|at|in|for|near|nach|an|au|à|a|en|für|pour|para))\W{0,4}$")
_NOT_STREET = re.compile(r"(?i)\b(?:main thread|upper bound|lower bound|line|port|build|step|page|version|chapter|slot|worker|node|thread)\b")


#: Where a street with its number in front may begin, and words that one with its number behind has.
_NO_FIRST = re.compile(rf"(?<![\w./#-])\d{{1,5}}(?:[a-zA-Z]|\s(?:bis|ter|quater))?,?\s(?=[{_UP}{_LOW}])")
_NO_LAST = re.compile(rf"{_TYPE_DE}\s\d")
_STREET_WORDS = ("C/ ", "Calle ", "Aven", "Avda", "Av. ", "Plaza", "Pza", "Paseo ", "Pº ", "Camino ", "Carretera ", "Ctra", "Ronda ", "Travesía ", "Callej", "Cuesta ", "Glorieta ", "Rambla ",
    "Am ", "An der ", "An den ", "Auf de", "Im ", "In der ", "Zum ", "Zur ", "Unter den ", "Hinter de", "Beim ", "rue ", "Rue ", "oulevard ", "mpasse ", "hemin ", "STRASSE ", "STRAßE ", "STR. ", "GASSE ", "WEG ", "ALLEE ", "PLATZ ", "RING ", "DAMM ", "UFER ")


_HEAD = re.compile(r"(?:(?:Wohnt|Wohnhaft|Lieferung|Adresse|Anschrift|Nach|In|An|Bei|Zu|Zur|Zum)\s)+")


def _streets(t: str) -> Iterable[tuple[int, re.Match]]:
    for n in _NO_FIRST.finditer(t):
        for k in (0, 1):
            if m := ADDRESS[k].match(t, n.start()):
                yield k, m
    if any(w in t for w in _STREET_WORDS) or _NO_LAST.search(t):
        for k in range(2, len(ADDRESS)):
            for m in ADDRESS[k].finditer(t):
                yield k, m


def _addresses(t: str) -> Iterable[tuple[int, int, float]]:
    for k, m in _streets(t):
        score = 0.3 if k == 5 else 0.6
        if _ADDRESS_WORDS.search(t[max(0, m.start() - 28) : m.start()]) or _cell(t, m.start(), m.end()):
            score += 0.3
        if k == 5 and re.search(r",\s\d{5}\s|\d[a-z]$", m.group()):
            score += 0.3
        if _NOT_STREET.search(m.group()):
            score -= 0.6
        head = _HEAD.match(m.group()) if k == 3 else None
        yield m.start() + (head.end() if head else 0), m.end(), score


# ---------------------------------------------------------------- name

_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Herrn|Hr|Fr|M|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señor|Señora|Don|Doña|Sir|Lady)"
_PART = r"(?:(?:van|von|de|del|der|den|di|da|la|le|du|ter|zu)\s){0,2}"
NAME = re.compile(
    rf"(?<![\w@./+\\-])(?:(?P<title>{_TITLE})\.?\s)?(?:(?P<first>{_W}|[{_UP}]\.)(?:\s(?P<mid>[{_UP}]\.)){{0,2}}\s(?:{_PART})(?P<last>{_W})|(?P<fam>{_W}),\s(?P<giv>{_W}|[{_UP}]\.)(?:\s[{_UP}]\.)?)(?![\w@/\\]|[-.]\w)"
)
_LOWER = rf"(?<![\w@./+\\-])(?:(?P<g>%s)(?:\s[a-z]\.)?\s(?P<l>[{_LOW}]{{3,}})|(?P<l2>[{_LOW}]{{3,}}),\s(?P<g2>%s))(?![\w@/\\]|[-.]\w)"
# Cues by class, in English, German, French and Spanish: who acts in a report, whom one talks to, roles of people, sources of a statement, owners, labels of fields.
_DONE_BY = r"(?:report|sign|open|fil|rais|approv|request|assign|creat|author|review|submitt|fix|clos|confirm|suggest|not|prepar|book|order|complet|reject|updat|invit|call|refus)e?d(?:\s(?:off|up|on|in))?\sby|(?:written|sent|found|seen|made|given|done|paid|led|held)\sby|(?:gemeldet|erstellt|geschrieben|geprüft|unterschrieben|gesendet)\svon|(?:signalé|écrit|signé|envoyé|créé|ouvert|demandé)e?\spar|(?:firmad|escrit|enviad|cread|abiert|reportad|solicitad)[oa]\spor"
_TALK_TO = r"(?:ask|tell|call|phone|email|mail|contact|message|thank|notify|remind|invite|meet|interview|greet|cc|dear|frag(?:e|t|en)?|ruf(?:e|t|en)?|lieber?|sehr geehrte[rs]?|demand(?:e|ez|er) à|appel(?:le|ez|er)|contact(?:e|ez|er)|cher|chère|pregunt(?:a|e|ar) a|llam(?:a|e|ar) a|estimad[oa]|querid[oa])|(?:meeting|call|appointment|interview|spoke|talk(?:ed)?|chat|lunch|met|treffen|termin|gespräch|rendez-vous|réunion|entretien|reunión|cita)\s(?:with|mit|avec|con)"
_ROLES = r"(?:customer|client|user|employee|patient|applicant|tenant|buyer|guest|caller|colleague|manager|owner|author|reviewer|assignee|reporter|contact|signed|kund(?:e|in|en)|mitarbeiter(?:in)?|kolleg(?:e|in)|nutzer(?:in)?|antragsteller(?:in)?|patientin|mieter(?:in)?|cliente|client[e]?|collègue|utilisat(?:eur|rice)|employée?|locataire|usuari[oa]|emplead[oa]|compañer[oa]|inquilin[oa]|paciente)"
_SOURCE = r"(?:according to|laut|gemäß|según|selon|d['’]après)"
_OWNER = r"(?:belong(?:s|ed|ing)? to|owned by|on behalf of|gehör(?:t|te|en)(?: zu)?|im auftrag von|apparten\w+ à|appartient à|au nom de|perten\w+ a|a nombre de)"
_LABEL = r"(?:[a-z_]*name|nom|nombre|user|customer|client|kunde|assignee|author|owner|reviewer|reporter|contact|from|to|cc|q|attn)"
_NAME_BEFORE = re.compile(rf"(?i)(?:\b{_DONE_BY}|\b{_TALK_TO}|\b{_ROLES}:?|\b{_SOURCE}|\b{_OWNER}|\b{_LABEL}\W{{1,4}}|\b(?:by|from|to|with|for|of|is|mit|von|für|bei|avec|par|pour|de|con|por|para|regards,?|grüße,?|gruß,?|cordialement,?|saludos,?|síncer\w*|mr|mrs|ms|herr|frau))\s*[\"']?$")
_STRONG = re.compile(rf"(?i)(?:\b{_DONE_BY}|\b{_TALK_TO}|\b(?:the|our|my|a|der|die|den|dem|unser\w*|le|la|notre|el|nuestr[oa])\s{_ROLES}|\b{_ROLES}:|\b{_SOURCE}|\b{_OWNER}|\b{_LABEL}(?:\W{{2,4}}|[=:]))\s*[\"']?$")
#: What people do, after their names.
_NAME_AFTER = re.compile(r"(?i)^,?\s*(?:says?|said|writes?|wrote|asks?|asked|reports?|reported|confirms?|confirmed|called|thinks?|wants?|lives?|works?|joined|signed|sagt|sagte|schreibt|schrieb|meldet|meldete|fragt|wohnt|arbeitet|möchte|(?:a|avait)\s(?:dit|écrit|signalé|demandé|confirmé)|dit|écrit|habite|travaille|dice|dijo|escribe|escribió|indica|informa|pregunta|vive|trabaja|ha\s(?:dicho|escrito|informado))\b")
#: Words that are no names though capitals begin them: what begins sentences, salutations, the calendar, products.
_NOT_NAMES = frozenset(
    """a an the this that these those and or but if when while where why how what which who whose as at by for from in into of off on to with without about after before since until our my your his her its their
    i we you he she it they one all any some each every no not is are was were be been do does did has have had can could may might must shall should will would
    der die das den dem des ein eine einen einem einer und oder aber wenn als wie was wer wo warum mit ohne von vor nach bei seit bis aus für durch gegen um zu zum zur im am an auf in ist sind war nicht kein keine ich du er sie es wir ihr
    le la les un une des du de et ou mais si quand où qui que quoi avec sans pour par sur sous dans en au aux est sont pas je tu il elle on nous vous ils elles ce cette ces son sa ses
    el los las una unos unas y o pero cuando donde quien con sin para por sobre bajo entre es son no yo tú él ella nosotros ustedes ellos este esta estos su sus se al del
    thanks thank hello hi dear please regards cheers danke hallo bitte liebe lieber gruß merci bonjour salut cher chère gracias hola saludos estimado estimada
    january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday today tomorrow yesterday
    januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag
    janvier février mars avril juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche
    enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo
    see use add set get put ask call ping tell send show open close check fix run move read write make take keep find update delete create siehe voir véase note
    error warning info debug exception value type key index null true false line page step build version port order thread class upper lower main api url uuid json sql http
    docker compose git github visual studio mac os windows linux java script python actions
    customer client cliente kunde kundin user owner author assignee reviewer contact name phone tel mail email address passport id ssn dni nino personalausweis
    reported signed according laut selon según reference""".split()
)


def _cell(t: str, a: int, b: int) -> bool:
    """Whether the span fills a cell, a field or a quoted value."""
    before, after = t[max(0, a - 3) : a], t[b : b + 3]
    left = not before.strip(" ") or re.search(r"[|;\t\n]\s?$|[\"'=]$|^\s*$", before) is not None
    right = not after.strip(" .") or re.match(r"\s?[|;\t\n]|[\"']|\\n", after) is not None
    return left and right


def _names(t: str, given: frozenset[str], lower: re.Pattern | None) -> Iterable[tuple[int, int, float]]:
    at = 0
    while m := NAME.search(t, at):
        at = m.end()
        parts = [p for p in (m["first"], m["last"], m["fam"], m["giv"]) if p]
        words = [w for p in parts for w in re.split(r"[-\s]", p)]
        first, last = (m["first"], m["last"]) if m["first"] else (m["giv"], m["fam"])
        low = [w.lower().rstrip(".") for w in parts]
        if any(x in _NOT_NAMES for x, w in zip(low, parts) if len(w) > 2 or w[-1] != "."):
            at = m.start() + max(1, len(re.match(r"\S+", m.group()).group()))  # the next word may begin a name
            continue
        known = first.lower() in given or first.split("-")[0].lower() in given
        turned = last.lower() in given or last.split("-")[0].lower() in given
        if not known and turned and not m["fam"] and not m["title"] and re.match(rf"\s(?:{_PART})(?:{_W})(?![\w@])", t[m.end() :]):
            at = m.start() + max(1, len(re.match(r"\S+", m.group()).group()))  # a given name with a family name follows
            continue
        initial = first.endswith(".") and len(first) == 2
        before, after = t[max(0, m.start() - 30) : m.start()], t[m.end() : m.end() + 18]
        score = 0.45 if known else 0.25 if turned else 0.2
        if m["fam"]:
            score -= 0.25  # a comma may just divide
        elif known and len(words[-1]) > 2 and first[1:].isupper() == last[1:].isupper():
            score += 0.1
        if m["title"]:
            score += 0.4
        if _STRONG.search(before):
            score += 0.55 if m["fam"] else 0.45
        elif _NAME_BEFORE.search(before):
            score += 0.2
        if _NAME_AFTER.search(after):
            score += 0.25
        if _cell(t, m.start(), m.end()):
            score += 0.55 if m["fam"] else 0.35 if known or initial or turned else 0.3
        if initial and not m["fam"]:
            score -= 0.05
        if re.match(r"\s?\d|\sprotocol|\sAdapter|\(|::|\.\w", after) and not re.match(r"\s?\d{4,}", after):
            score -= 0.3
        yield m.start(), m.end(), score
    if lower is not None:
        for m in lower.finditer(t):
            score = 0.2
            before = t[max(0, m.start() - 30) : m.start()]
            if _STRONG.search(before):
                score += 0.4
            if _NAME_AFTER.search(t[m.end() : m.end() + 18]):
                score += 0.2
            if _cell(t, m.start(), m.end()):
                score += 0.4
            other = m["l"] or m["l2"]
            if other in _NOT_NAMES:
                score -= 0.5
            yield m.start(), m.end(), score


# ---------------------------------------------------------------- all kinds


class Finder:
    def __init__(self, given_names: Iterable[str] = ()):
        self.given = frozenset(g.lower() for g in given_names if g)
        alt = "|".join(sorted((re.escape(g) for g in self.given), key=len, reverse=True))
        self.lower = re.compile(_LOWER % (alt, alt)) if alt else None
        self.any_given = re.compile(rf"(?<![\w@])(?:{alt})(?!\w)") if alt else None

    def spans(self, t: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in order, without overlaps."""
        if not t:
            return []
        found: list[tuple[int, int, str]] = []
        digits = any(c in t for c in "0123456789")
        if _may_hold_email(t):
            found += [(a, b, "email") for a, b, s in _emails(t) if s >= THRESHOLD]
        if digits:
            found += [(a, b, "address") for a, b, s in _addresses(t) if s >= THRESHOLD]
            found += [(a, b, "id_number") for a, b, s in _ids(t) if s >= THRESHOLD]
            found += [(a, b, "phone") for a, b, s in _phones(t) if s >= THRESHOLD]
        low = self.lower if self.any_given is not None and self.any_given.search(t) else None
        found += [(a, b, "name") for a, b, s in _names(t, self.given, low) if s >= THRESHOLD]
        out: list[tuple[int, int, str]] = []
        for a, b, k in sorted(found, key=lambda x: (KINDS.index(x[2]), x[0] - x[1], x[0])):
            if all(b <= c or a >= d for c, d, _ in out):
                out.append((a, b, k))
        return sorted(out)

    def mask(self, t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for a, b, k in self.spans(t):
            out += [t[at:a], f"[{k.upper()}]"]
            at = b
        return "".join(out) + t[at:]

    def json_values(self, t: str | None) -> list[str]:
        """The texts to search in JSON: every string value with its key in front, decoded."""
        if not t:
            return []
        try:
            x = json.loads(t)
        except ValueError:
            return [_unescape(t)]
        out: list[str] = []

        def walk(v, key: str) -> None:
            if isinstance(v, dict):
                for k, w in v.items():
                    walk(w, str(k))
            elif isinstance(v, list):
                for w in v:
                    walk(w, key)
            elif isinstance(v, str):
                out.append(f'{key}="{v}"' if "\n" not in v else v)
            elif isinstance(v, int) and not isinstance(v, bool):
                out.append(f'{key}="{v}"')

        walk(x, "")
        return out

    def kinds(self, t: str | None, is_json: bool = False) -> set[str]:
        if not is_json:
            return {k for _, _, k in self.spans(t)}
        return {k for v in self.json_values(t) for _, _, k in self.spans(v)}

    def mask_json(self, t: str | None) -> str | None:
        if not t:
            return t
        try:
            x = json.loads(t)
        except ValueError:
            plain = _unescape(t)
            return self.mask(plain) if self.spans(plain) else t
        changed = False

        def walk(v, key: str):
            nonlocal changed
            if isinstance(v, dict):
                return {k: walk(w, str(k)) for k, w in v.items()}
            if isinstance(v, list):
                return [walk(w, key) for w in v]
            if isinstance(v, (str, int)) and not isinstance(v, bool):
                s = str(v)
                framed = f'{key}="{s}"' if "\n" not in s else s
                m = self.mask(framed)
                if m != framed:
                    changed = True
                    return m[len(key) + 2 : -1] if framed is not s and m.startswith(f'{key}="') and m.endswith('"') else m
            return v

        y = walk(x, "")
        return json.dumps(y, ensure_ascii=False) if changed else t


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\n|\\t|\\r|\\\"|\\\\|\\/")


def _unescape(t: str) -> str:
    plain = {"\\n": "\n", "\\t": "\t", "\\r": "\r", '\\"': '"', "\\\\": "\\", "\\/": "/"}
    s = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else plain[m.group()], t)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _given(given_names: DataFrame, most: int = 100_000) -> list[str]:
    """The reference list, whose size is checked: a list of more than ``most`` names isn't one."""
    rows = given_names.select("given_name").where("given_name is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("given_names is too long for a reference list")
    return sorted(r[0] for r in rows)


def found(df: DataFrame, table: str, id_col: str, fields: dict[str, bool], given_names: DataFrame) -> DataFrame:
    """(item_table, item_id, field, kind) for every kind that occurs in a field; fields: {name: whether it is JSON}."""
    names = _given(given_names)
    cols = list(fields)

    def run(batches):
        f = Finder(names)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for j, c in enumerate(cols):
                is_json = fields[c]
                for i, t in zip(ids, b.column(j + 1).to_pylist()):
                    if t:
                        rows += [(i, c, k) for k in f.kinds(t, is_json)]
            out = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=["item_id", "field", "kind"])

    src = df.select(F.col(id_col).cast("string").alias("item_id"), *cols)
    return src.mapInArrow(run, "item_id string, field string, kind string").select(F.lit(table).alias("item_table"), "item_id", "field", "kind").distinct()


def masked(df: DataFrame, fields: dict[str, bool], given_names: DataFrame) -> DataFrame:
    """The rows with the fields masked; all other columns stay."""
    names = _given(given_names)
    cols = df.columns

    def run(batches):
        f = Finder(names)
        for b in batches:
            arrays = []
            for name, col in zip(b.schema.names, b.columns):
                if name in fields:
                    col = pa.array([(f.mask_json if fields[name] else f.mask)(t) for t in col.to_pylist()], pa.string())
                arrays.append(col)
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return df.mapInArrow(run, df.schema)
