import os
import random

import numpy as np
import pytest

from tessera.llm import abuse, abuse_train

S = abuse.Scorer()


@pytest.mark.parametrize(
    "text",
    [
        "You are a stupid worthless pig and everyone here hates you.", "Y O U  are such an i d i o t, nobody can stand you.", "Halt die Fresse, du dummes Schwein.", "Espèce de connard, ferme ta gueule.", "Eres un imbécil y nadie te soporta, cállate.",
        "These foreigners are vermin and should be driven out.", "Free p0rn, hot n*de girls, join now.", "I will find you and break your neck.",
    ],
)
def test_abuse_is_found(text):
    assert S.scores([text, "The job failed again. " * 40 + text + " It was restarted twice. " * 40])[0] >= 0.5


@pytest.mark.parametrize("text", ["Kill the zombie process and reap its orphaned children.", "This code is garbage and the build is a disaster.", "The sex column of the form allows null.", "Der verwaiste Kindprozess wird getötet.", "We saw the queue flush twice when the flag was cached.", "", "   ", None, "def f(x):\n    return x + 1", "漢字 проверка 123"])
def test_harmless_texts(text):
    assert S.scores([text])[0] < 0.5


def test_tokens_undo_disguises():
    assert abuse.tokens("You іdiоt, l0$3r, veeeery s t u p i d, I.d.i.o.t") == ["you", "idiot", "loser", "very", "stupid", "idiot"]
    assert abuse.tokens("src/a.py:12 v1.2 fooBarBaz 0x9f") == ["src", "a", "py", "0", "v1", "2", "foo", "bar", "baz", "0x9f"] or abuse.tokens("") == []


def test_windows_cover_all_words():
    for n in (0, 1, 9, 10, 11, 40, 101):
        w = abuse.windows(n)
        assert set(range(n)) == {i for s in w for i in range(s, min(n, s + abuse.WINDOW))} and len(w) == (max(1, n - abuse.WINDOW + 1) if n else 0)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in abuse_train.params(rng).items()}
    batch, y = [["a", "bc", "def"], ["gh"]], np.array([1.0, 0.0])
    _, g = abuse_train.gradients(p, batch, y, np.random.default_rng(1))
    for k, at in (("fx", (3, 5)), ("bh", (2, 7)), ("fn", (4,)), ("u", (6,)), ("o", (1,)), ("char", (abuse.hashed("def")[1][0], 2)), ("bb", (9,))):
        d = 1e-3
        p[k][at] += d
        a, _ = abuse_train.gradients(p, batch, y, np.random.default_rng(1))
        p[k][at] -= 2 * d
        b, _ = abuse_train.gradients(p, batch, y, np.random.default_rng(1))
        p[k][at] += d
        assert abs((a - b) / (2 * d) - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


#: Written apart from the training lists and from any table, to measure by kind and language; none of them is trained on.
HELD_OUT = {
    ("insult", "en"): ["Seriously, only a complete moron could ship this, and that moron is you.", "Go back to flipping burgers, you talentless hack of a human.", "Dave is a lying sack of crap and everybody knows it."],
    ("insult", "de"): ["Du hast echt nichts im Kopf, du hirnloser Trottel.", "Unser neuer Kollege ist ein widerliches Schwein.", "Ach halt doch dein dummes Maul, du Clown."],
    ("insult", "fr"): ["Franchement t'es trop con pour comprendre ça.", "Ce crétin de Paul n'est qu'un minable.", "Ferme-la un peu, pauvre abruti."],
    ("insult", "es"): ["De verdad que eres el tío más imbécil del mundo.", "Ese cerdo asqueroso no merece ni el sueldo.", "Cierra la boca, payaso, que das pena."],
    ("threat", "en"): ["One day I am going to smash your skull with a hammer.", "Someone should put a bullet in him.", "Keep talking and I will hunt you down and kill you."],
    ("threat", "de"): ["Ich breche dir beide Arme, wenn ich dich sehe.", "Am besten bringst du dich gleich um.", "Dich sollte man an die Wand stellen und erschießen."],
    ("threat", "fr"): ["Je vais te péter les dents à la sortie.", "Tu ferais mieux de te pendre.", "On va te retrouver et te tuer."],
    ("threat", "es"): ["Te voy a partir la cara en cuanto te vea.", "Ojalá te mueras de una vez.", "Vamos a matar a ese desgraciado."],
    ("hate", "en"): ["Immigrants are parasites and ought to be deported, every single one.", "Women are too emotional to write software, keep them out.", "The Dravonites are filthy animals that must be wiped out."],
    ("hate", "de"): ["Ausländer sind doch alles Kriminelle, raus mit dem Pack.", "Frauen gehören an den Herd und nicht ins Büro.", "Diese Karvonier sind Ungeziefer und gehören vernichtet."],
    ("hate", "fr"): ["Les immigrés sont tous des voleurs, il faut les expulser.", "Les femmes sont trop bêtes pour programmer.", "Ces Morvaliens sont de la vermine à exterminer."],
    ("hate", "es"): ["Los inmigrantes son todos unos delincuentes, que los echen.", "Las mujeres no sirven para esto, a la cocina.", "Esos karvonios son ratas y hay que exterminarlos."],
    ("sexual", "en"): ["Hey sexy, I would love to lick your naked body all night.", "Hot busty teens get fucked on live webcam, click here.", "She spread her legs and moaned as he pushed into her."],
    ("sexual", "de"): ["Ich will deine geilen Titten anfassen.", "Nackte willige Hausfrauen wollen dich heute ficken.", "Er riss ihr die Bluse auf und leckte ihre Brüste."],
    ("sexual", "fr"): ["J'ai trop envie de te baiser sur la table.", "Des étudiantes nues et coquines en webcam porno.", "Elle gémissait pendant qu'il lui léchait les seins."],
    ("sexual", "es"): ["Quiero follarte encima de la mesa, guapa.", "Chicas desnudas y calientes, porno gratis en directo.", "Ella gemía mientras él le chupaba las tetas."],
    ("none", "en"): ["The scheduler kills idle workers after ten minutes.", "This stupid regex took me all afternoon.", "Damn, I forgot to push the tag again.", "We added a field for women's sizes and one for men's.", "Moderators removed three posts with threats against migrants.", "The shell script strips comments and executes the rest."],
    ("none", "de"): ["Verdammt, der Build ist schon wieder rot.", "Der Prozess stirbt, sobald der Speicher voll ist.", "Flüchtlinge bekommen ein eigenes Formular."],
    ("none", "fr"): ["Merde, le test échoue encore.", "Le processus a été tué par le noyau.", "Les femmes représentent la moitié de l'équipe."],
    ("none", "es"): ["Joder, otra vez falla la compilación.", "El proceso muere cuando falta memoria.", "Los refugiados pueden pedir cita en línea."],
}
AROUND = "The nightly job copies the tables and then checks their counts. It ran for forty minutes today. "


def test_held_out_accuracy():
    """Sentences written apart: recall over all abusive ones and precision, alone and in the midst of other text."""
    at = S.net.threshold
    got = {k: [S.scores([t, AROUND + t + " " + AROUND]) >= at for t in v] for k, v in HELD_OUT.items()}
    found = [x.all() for (kind, _), v in got.items() if kind != "none" for x in v]
    wrong = [x.any() for (kind, _), v in got.items() if kind == "none" for x in v]
    print({k: f"{sum(x.all() for x in v)}/{len(v)}" for k, v in got.items()})
    assert np.mean(found) >= 0.75 and np.mean(wrong) <= 0.2


def test_composed_passages_in_harmless_text():
    rng = random.Random(99)
    good = ["We saw the {0} flush twice when the {1} was cached.", "Rollback took 3 minutes since the {0} had to {1} each file.", "Il faut vérifier {0} avant de fusionner.", "Der {0} muss vor jedem {1} neu gebaut werden.", "La función {0} devuelve una lista vacía."]
    plain = [" ".join(rng.choice(good).format(abuse_train.name(rng), abuse_train.name(rng)) for _ in range(8)) for _ in range(150)]
    bad = [p[: len(p) // 2] + " " + abuse_train.disguise(abuse_train.compose(rng), rng) + " " + p[len(p) // 2 :] for p in plain]
    at = S.net.threshold
    assert (S.scores(plain) >= at).mean() <= 0.02 and (S.scores(bad) >= at).mean() >= 0.8


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_labels_of_other_rows():
    """Documents of another scale than that of training: what annotators call harmless is almost never flagged."""
    import pandas as pd

    d = "/root/testdata/sf0.01"
    l = pd.read_parquet(f"{d}/labels.parquet").dropna().groupby("doc_id").toxic.mean()
    t = pd.read_parquet(f"{d}/documents.parquet").set_index("doc_id").text
    ids = [i for i in l.index if i in t.index]
    s = S.scores([t[i] for i in ids])
    assert ((s >= S.net.threshold) & (l[ids].to_numpy() < 0.5)).mean() <= 0.03


def test_rows(spark):
    df = spark.createDataFrame([(1, "You worthless idiot, kill yourself.", "a"), (2, None, "a"), (3, "", None), (4, "x " * 20000, "b"), (1, "You worthless idiot, kill yourself.", "a")], "doc_id long, text string, source string").selectExpr("*", "0.5 as score")
    got = {(r["doc_id"], r["score"] >= 0.5) for r in abuse.score(df).collect()}
    assert got == {(1, True), (2, False), (3, False), (4, False)}
    r = {x["source"]: (x["n_docs"], x["n_flagged"]) for x in abuse.rates(abuse.score(df, extra=("source",))).collect()}
    assert r == {"a": (3, 2), None: (1, 0), "b": (1, 0)}
    assert abuse.score(df.limit(0)).count() == 0


def test_long_words_are_read_to_their_end(monkeypatch):
    head = "internationalizationconfiguration"
    assert len(abuse.hashed(head + "idiot")[1]) == len(head) + 5
    net = abuse.Network.load()
    words = [head + "idiot", "ok", head + "value", "x" * 5000, "a"]
    e = net.embed(words)
    assert abs(e[0, abuse.DIM :] - e[2, abuse.DIM :]).max() > 1e-4
    monkeypatch.setattr(abuse, "GRAMS", 10)
    assert abs(net.embed(words) - e).max() < 1e-6
