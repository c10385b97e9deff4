import pytest

from tessera.llm import personal as p

F = p.Finder(["Klara", "Thomas", "Wei", "Zoe", "Priya"])

CASES = [
    ("send it to klara.vander+x@corvane.example.", {"email"}), ("row | kvern-ma%40post.velbrück.example |", {"email"}), ("mail: a.b [at] ostwin.invalid", {"email"}), ("reply-to: doslund (@) lumbera.test", {"email"}),
    ("reach kofi dot marrin at mail dot tarnholt dot test now", {"email"}), ("KLARA.VANDER@CORVANE.EXAMPLE", {"email"}),
    ("call +44 20 7946 0299 now", {"phone"}), ("tel 202.555.0152.", {"phone"}), ("(718) 555-0131", {"phone"}), ("phone: 16175550120.", {"phone"}), ("Rückruf unter +49 (0)30 23125 412", {"phone"}), ("0034 600 000 696", {"phone"}), ("+33 1 99 00 34 86", {"phone"}), ("07700 900214", {"phone"}),
    ("SSN 986 22 4296 is doubled", {"id_number"}), ("id check: 918-54-9175", {"id_number"}), ("tax id 943-75-1535", {"id_number"}), ("passport no. X32715143", {"id_number"}), ("Personalausweis T3052622X", {"id_number"}), ("DNI 00006217-T", {"id_number"}), ("doc=\"NINO QQ 71 91 89 C\"", {"id_number"}),
    ("lives at 118 Merrowdale Avenue, Apt 3B, Ostwin", {"address"}), ("wohnt Am Krähenturm 165b.", {"address"}), ("addr=\"Steinbrückerstraße 114, 98578 Tarnholt\"", {"address"}), ("Livraison au 116 rue des Tilleuls-Gris", {"address"}), ("C/ Ribera Honda 159, 9º B", {"address"}), ("Avenida de los Olmos Blancos 72, 6º A", {"address"}), ("envío a Alte Färberallee 29", {"address"}),
    ("reported by Klara Vander this morning", {"name"}), ("assignee: ZOE MARRIN.", {"name"}), ("| 12 | Vander, Thomas |", {"name"}), ("signed off by Quirin Yarrow-Holt.", {"name"}), ("user=\"T. Vander\" msg", {"name"}), ("le client Herr Wei von Vander a signalé", {"name"}),
    ("laut I. Núñarez tritt das auf", {"name"}), ("assignee: Fenwicke, Anselm.", {"name"}), ("; Vexholm, Dagny ;", {"name"}), ("the label prints Am Krähenturm 20c on two lines.", {"address"}),
    ("Ping Klara when it is done.", set()), ("Thanks, Priya, that was the linter.", set()), ("Class ThomasAdapter wraps the Zoe protocol in x.", set()), ("git@forge.corvane.example:tools/x.git", set()), ("pins flextable@4.17.52 and @corvane/ui@2.3.1", set()),
    ("Order 912-441-8731-3 has 7", set()), ("Serial T-900-763-X", set()), ("Port 55501 is taken, use 8081", set()), ("Checksum 0x9f3ab2847 differs from 415555068677ef.", set()), ("GET /v2/street/14/unit/786 returns 404", set()), ("Move to Main Thread 498, then Upper Bound 887.", set()),
    ("Docker Compose starts x after 307 retries", set()), ("Build 2024.11.05-888 took 12:04:33 on node 10.0.0.741.", set()), ("At 2024-03-677 it moved to slot 202.555.x.", set()), ("ValueError in Zeile 132 von src/x.py", set()), ("The @Injectable() decorator", set()), ("", set()), (None, set()),
]


@pytest.mark.parametrize("text, want", CASES)
def test_kinds(text, want):
    assert F.kinds(text) == want


def test_masking_keeps_the_rest():
    t = "a\r\n  reported by Klara Vander,\tkv@x.example; 07700 900214\n\n"
    assert F.mask(t) == "a\r\n  reported by [NAME],\t[EMAIL]; [PHONE]\n\n"
    assert F.mask("Wohnt Alte Färberallee 29.") == "Wohnt [ADDRESS]."
    clean = "nothing here \u2003 \r\n"
    assert F.mask(clean) == clean and F.mask(None) is None and F.mask("") == ""


def test_json_values_count_decoded():
    a = r'{"to": "s\u00e9verin.lomberg\u0040mail.tarnholt.test", "n": 1, "deep": [{"customerName": "Klara Vander"}]}'
    assert F.kinds(a, True) == {"email", "name"}
    import json

    m = json.loads(F.mask_json(a))
    assert m["to"] == "[EMAIL]" and m["deep"][0]["customerName"] == "[NAME]" and m["n"] == 1
    untouched = '{"path":  "src/a.ts"}'
    assert F.mask_json(untouched) == untouched
    assert F.kinds('{"contact": "kv@x.example", "cut', True) == {"email"} and F.mask_json("{") == "{"


def test_validators():
    assert p.luhn("79927398713") and not p.luhn("79927398710")
    assert p.mod97("255081416802538") and not p.mod97("255081416802539")
    assert p.mod11_10("86095742719") and not p.mod11_10("86095742718")


def test_long_and_odd_texts_are_quick():
    import time

    t = time.time()
    for x in ("a@" * 20_000, "1 " * 40_000, "A " * 40_000, "x" * 200_000, "Aa-" * 30_000, "at dot " * 10_000, "(" * 50_000, "Main Street 1 " * 5_000):
        F.spans(x)
    assert time.time() - t < 60


def test_rows(spark):
    names = spark.createDataFrame([("Klara",), ("Klara",), (None,)], "given_name string")
    df = spark.createDataFrame([("1", "kv@x.example 07700 900214", None), ("1", "kv@x.example 07700 900214", None), ("2", None, '{"q": "Klara Vander"}'), ("3", "", "")], "id string, result_excerpt string, args string").selectExpr("*", "'x' as kind", "'y' as field")
    got = {tuple(r) for r in p.found(df, "tool_calls", "id", {"result_excerpt": False, "args": True}, names).collect()}
    assert got == {("tool_calls", "1", "result_excerpt", "email"), ("tool_calls", "1", "result_excerpt", "phone"), ("tool_calls", "2", "args", "name")}
    m = {r["id"]: (r["result_excerpt"], r["args"], r["kind"]) for r in p.masked(df, {"result_excerpt": False, "args": True}, names).collect()}
    assert m["1"] == ("[EMAIL] [PHONE]", None, "x") and m["2"] == (None, '{"q": "[NAME]"}', "x") and m["3"] == ("", "", "x")
    assert p.found(df.limit(0), "t", "id", {"args": True}, names).count() == 0


GATED = [
    ("AB123456C", {"id_number"}), ("AB 123456 C", {"id_number"}), ("his NINO: AB123456C.", {"id_number"}), ("National Insurance QQ123456B", {"id_number"}), ("Pass C01X00T47", {"id_number"}), ("SSN AB123456", {"id_number"}),
    ("ana (arroba) empresa.es", {"email"}), ("eva [arroba] x.es", {"email"}), ("uli (ät) firma.de", {"email"}), ("ANA ARROBA EMPRESA PUNTO ES", {"email"}), ("uli at firma PUNKT de", {"email"}), ("léa AT site POINT fr", {"email"}), ("kofi at mail(.)test", {"email"}), ("kofi at mail(dot)test", {"email"}),
    ("order 123456 is late", set()), ("see EXCEPTION at line 123456", set()), ("at this point we stop", set()),
]


@pytest.mark.parametrize("text, want", GATED)
def test_gates_let_pass_what_the_patterns_accept(text, want):
    assert F.kinds(text) == want


def test_no_number_lies_outside_the_windows():
    import random

    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice(["A", "B", "C", "X", "T", "x", " ", " ", "-", ".", "1", "2", "07", "85", "123", "2A", "ssn "]) for _ in range(rng.randint(4, 40)))
        whole = {m.span() for m in p.ID.finditer(t) if any(c.isdigit() for c in m.group())}
        assert whole == {m.span() for m in p._all(p.ID, t, p._around(t, p._ID_RUN.finditer(t), 12, 16)) if any(c.isdigit() for c in m.group())}, t


#: Written apart from any table, to measure by kind; the names are not in the reference list but for those of "known name".
HELD_OUT = {
    "known name": ["I spoke to Klara Hoffmeister about it.", "Thomas Brandt wrote the first version.", "KLARA WINTER, head of sales", "The slides are from Priya Raman.", "Zoe Lindqvist verlässt das Team.", "Merci à Klara Dubois pour son aide.", "Wei Zhang firmó el contrato."],
    "cued name": ["The customer Gudrun Achterberg wants a refund.", "Approved by Marisol Quintero.", "Please call Fergus O'Malley tomorrow.", "Laut Benedikt Sorge ist das erledigt.", "Selon Mathilde Lefèvre, tout fonctionne.", "Según Iñaki Zubiri falta un campo.", "author: Saoirse Kinsella", "Dr. Eleanor Whitcombe will see you now.", "Frau Ottilie Krause hat angerufen.", "Monsieur Gaspard Rolland est absent.", "name=\"Bartholomew Finch\"", "The laptop belongs to Rosalind Pike."],
    "bare name": ["Eleanor Whitcombe was late again.", "Yesterday Gaspard Rolland broke the build.", "We owe Ottilie Krause a drink."],
    "email": ["write to eleanor.whitcombe@mailbox.example please", "contact: ek at posteo dot example", "bonjour(at)exemple.test", "support%40firma.example"],
    "phone": ["my number is +44 7700 900123", "ring 020-7946-0018 or leave it", "Tel.: 030 12345678", "+1 (415) 555-0132 after six", "06 12 34 56 78 le soir", "llámame al 612 345 678"],
    "id_number": ["SSN: 219-09-9999", "my passport number is C01234567", "NINO AB 12 34 56 C", "DNI 12345678Z", "Steuer-ID 86 095 742 719", "numéro de sécurité sociale 2 55 08 14 168 025 38"],
    "address": ["She lives at 42 Wisteria Lane.", "Lieferung an Gartenstraße 17, 10115 Berlin", "j'habite 8 rue de la République, Lyon", "Calle Mayor 21, 3º B", "Send it to 1600 Sycamore Avenue, Suite 12."],
    "none": ["The Blue Whale release ships on Monday.", "Open Visual Studio and pick Build Solution.", "Call Stack Overflow was raised.", "Version 10.4.22 fixed it at 12:30:45.", "Order 5512-998-1 shipped to the warehouse.", "He uses port 44321 on host ten.", "Der Neue Server läuft seit Montag.", "La Base de Datos está llena.", "See Section Four and Table Nine.", "klara is on holiday", "user kvander pushed 3 commits"],
}


def test_held_out_recall_by_kind():
    got = {k: [(k.split(" ")[-1] in F.kinds(t)) if k != "none" else bool(F.kinds(t)) for t in v] for k, v in HELD_OUT.items()}
    print({k: f"{sum(v)}/{len(v)}" for k, v in got.items()})
    share = {k: sum(v) / len(v) for k, v in got.items()}
    assert min(share[k] for k in ("known name", "cued name", "email", "phone", "id_number", "address")) >= 0.6 and share["none"] <= 0.2
