"""Sentence cutting, run logic, and held-out accuracy of the language model."""

import numpy as np
import pytest

from symloom.llm import languages as lg

EN = ["The parser reads every file before the run is over.", "Nobody has asked for the second edge, so the graph keeps it."]
DE = ["Der Parser liest jede Datei, bevor der Lauf beendet wird.", "Unser Graph meldet die alten Einträge, weil die Sprache unbekannt ist."]
FR = ["L'analyseur lit chaque fichier avant la fin du traitement.", "Notre graphe conserve les anciennes entrées parce que la langue est inconnue."]
RU = ["Разборщик проверяет все недостающие ссылки до конца работы.", "Новый указатель пропускает путь, которого больше нет."]
JA = ["解析器は存在しないパスを移動します。", "新しい索引は足りない参照をすべて置き換えます。"]
CODE = "```python\ndef f(a):\n    the_value = load(a)\n    return the_value\n```"


@pytest.mark.parametrize(
    ("text", "n"),
    [
        (None, 0), ("", 0), (" \n\t", 0), (" ".join(EN), 2), ("// " + EN[0] + "\n// " + EN[1], 2), ("# Title and the rest\n\n" + EN[0], 1), ("# " + EN[0], 1),
        (CODE, 0), ("feat(x): " + CODE + "\n" + EN[0], 1), ("- ```c\n  int a;\n  ```\n- " + EN[0], 1), ("".join(JA), 2), ("> " + JA[0] + "\n\n" + JA[1], 2),
        ("00166562 d3a9c39faa8f5dab f33b65b5fc80e494\n" * 5, 0), ("  at a.bC (pipeline.ts:142)\n  at d.eF (x.ts:1)", 0), ("a/b.py | 61 ++++\nc/d.go | 22 ++", 0),
        (EN[0].replace(" ", "\n"), 1), ('He said "' + EN[0] + '" ' + EN[1], 2), ("```\nnever closed " + EN[0], 0), (EN[0].replace(" ", "\xa0"), 1), ((EN[0] + " ") * 5000, 5000),
    ],
)
def test_sentences(text, n):
    assert len(lg.sentences(text)) == n


def rows(*langs):
    p = np.full((len(langs), 3), 0.01)
    for i, x in enumerate(langs):
        p[i] = [0.34, 0.33, 0.33] if x is None else [0.98 if x == j else 0.01 for j in range(3)]
    return p


def counted(p, short=()):
    runs = lg.segments(p, short)
    return {r.language for r, c in zip(runs, lg.counting_runs(runs), strict=True) if c}


def test_runs():
    assert lg.segments(rows()) == []
    assert counted(rows(0, 0, 1, 0, 0)) == {0}
    assert counted(rows(0, 0, 1, 1)) == {0, 1}
    assert counted(rows(0)) == {0}
    assert counted(rows(0, 0, 1, None, 0, 0)) == {0}
    assert counted(rows(None, 2, 2)) == {2}
    assert counted(rows(0, 0, 1, 1), [False, False, False, True]) == {0}
    assert counted(rows(0, 1, 0)) == {0}
    assert counted(rows(None)) == {0}


def test_labels(spark):
    values = ["en", "EN", "en-US", "en_GB", "pt-BR", " en", "eng", "english", "en US", "", None, "??", "zh", "go", "es-419", "de-"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(lg.label_language(df.v)).collect()]
    assert got == ["en", "en", "en", "en", "pt", None, None, None, None, None, None, None, "zh", "go", "es", None]


def test_identify(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    cases = {
        1: (" ".join(EN), "en", set()), 2: (" ".join(EN), "de", {"en"}), 3: (" ".join(DE), None, {"de"}), 4: (" ".join(EN + DE), "en", {"en", "de"}),
        5: (" ".join(FR) + "\n\n" + " ".join(RU) + "\n\n" + "".join(JA), "mul", {"fr", "ru", "ja"}), 6: (EN[0] + " " + DE[0] + " " + EN[1], "en-US", set()),
        7: (CODE, "xx", set()), 8: (None, None, set()), 9: (" \n", None, set()), 10: (JA[0], "zh", {"ja"}), 11: (FR[0], "FR_fr", set()), 12: (CODE + "\n\n" + RU[1], "go", {"ru"}),
    }
    mine = [(-i, t, label) for i, (t, label, _) in cases.items()] + [(None, EN[0], "en"), (-2, " ".join(EN), "de")]
    docs = base.unionByName(spark.createDataFrame(mine, "doc_id long, text string, lang string")).selectExpr("*", "1 AS doc", "'x' AS named")
    found = lg.identify(docs)
    wrong = {}
    for r in lg.mislabelled(found).collect():
        wrong.setdefault(r.doc, set()).add(r.lang)
        assert 0 < r.confidence <= 1
    assert {i: wrong.get(-i, set()) for i in cases} == {i: want for i, (_, _, want) in cases.items()}
    assert lg.identify(docs.limit(0)).count() == 0
    assert lg.identify(docs.where("doc_id = -3")).count() == 0


def test_held_out_accuracy_and_calibration(spark):
    """Sentences of documents that were not trained on; labels are partly
    wrong, so documents in scripts of their own serve as the strict check."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text and r.lang in lg.LANGUAGES]
    train, test = docs[::2], docs[1::2]
    texts = [(r.doc_id, s, r.lang) for r in train for s in lg.sentences(r.text)[:12]]
    model = lg.fit([d for d, _, _ in texts], [s for _, s, _ in texts], [x for _, _, x in texts], np.ones(lg.BUCKETS, np.float32))
    known = {model.languages[i]: i for i in range(len(model.languages))}
    right, p_right = [], []
    for r in test:
        for s in lg.sentences(r.text):
            script = "ja" if lg.is_short(s) is False and any("぀" <= c <= "ヿ" for c in s) else "ru" if sum("а" <= c <= "я" for c in s) > 10 else None
            if script:
                p = model.confidence([s])[0]
                right.append(p.argmax() == known[script])
                p_right.append(p.max())
    assert len(right) > 30 and np.mean(right) > 0.98
    agree = [model.confidence([" ".join(lg.sentences(r.text))])[0].argmax() == known[r.lang] for r in test if lg.sentences(r.text)]
    assert np.mean(agree) > 0.8
    assert abs(np.mean(p_right) - np.mean(right)) < 0.1
    assert (model.weights == 0).mean() > 0.5
    assert model.confidence([]).shape == (0, len(known))
    alone, together = model.confidence([EN[0]]), model.confidence([DE[1], EN[0], JA[0]])
    assert np.allclose(alone[0], together[1])


def test_undetermined(spark):
    rows = [(i, " ".join(x), n) for i, (x, n) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr"), (RU, "ru"), (JA, "ja")] * 12)]
    rows.append((900, "Wszystkie pliki zosta\u0142y odczytane przed ko\u0144cem pracy. Nikt nie pyta o drug\u0105 kraw\u0119d\u017a, wi\u0119c graf j\u0105 trzyma.", "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {(r.doc, r.lang) for r in lg.mislabelled(lg.identify(df, determined=0.9)).collect()}
    assert (900, "und") in found and found <= {(900, "und")}
    assert all(r.lang != "und" for r in lg.mislabelled(lg.identify(df, determined=0.0)).collect())
