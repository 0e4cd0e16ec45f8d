"""Repeated passages: exact results on small texts, and both rates on planted ones."""

import numpy as np

from tesselon.llm import passages

LINE = "This line of exactly twelve words stands in more than one text."
NEXT = "Another sentence follows it and it says things that nobody has ever said."


def cut(spark, texts):
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: (r["kept_text"], [(s["begin"], s["end"]) for s in r["removed"]]) for r in passages.without_repeats(df).collect()}


def test_runs_go_and_offsets_stay(spark):
    texts = {
        1: f"{LINE}\n{NEXT} Own words.",
        2: f"A start. {LINE.upper()}  {NEXT}\nThe end.",
        3: f"Only {NEXT}",
        4: f"{LINE}",
        5: f"head {LINE} {NEXT} tail",
        6: f"{LINE} * * * {NEXT}",
        7: f"Twice.\n{LINE}\n\n{NEXT}\nBetween.\n{LINE} {NEXT}",
        8: None,
        9: "",
    }
    got = cut(spark, texts)
    assert got[1] == (texts[1], []) and got[3] == (texts[3], []) and got[4] == (texts[4], [])
    assert got[2] == ("A start. The end.", [(9, 9 + len(LINE) + 2 + len(NEXT) + 1)])
    assert got[5] == (texts[5], [])  # both sentences share a unit with other words
    assert got[6] == ("", [(0, len(texts[6]))])  # marks without words between two units
    assert got[7][0] == "Twice.\nBetween.\n" and len(got[7][1]) == 2
    assert got[8] == (None, []) and got[9] == ("", [])
    for i, (kept, spans) in got.items():
        if spans:
            edges = [0, *[x for s in spans for x in s], len(texts[i])]
            assert kept == "".join(texts[i][a:b] for a, b in zip(edges[::2], edges[1::2]))


def test_rank_decides_and_not_the_order_of_rows(spark):
    rows = [(3, f"{LINE} {NEXT}"), (None, f"{LINE} {NEXT} x"), (3, f"{LINE} {NEXT}"), (2, f"{LINE} {NEXT}"), (3, f"y. {LINE} {NEXT}"), (1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for many in (1, 6):
        got = sorted((str(r["doc_id"]), r["text"], r["kept_text"]) for r in passages.without_repeats(df.repartition(many)).collect())
        assert got == sorted((str(i), t, {f"{LINE} {NEXT}": "", f"y. {LINE} {NEXT}": "y. "}.get(t, t)) for i, t in rows)


def test_units_tile_every_text():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab .!?,;:\n\r\t\x0b\xa0é"), int(rng.integers(0, 40))))
        found, forms = passages.text_units(text)
        assert "".join(found) == text and len(found) == len(forms)


def windows(text, n=51):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_planted_passages_are_caught_and_others_left_alone(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    rng, texts = np.random.default_rng(2), dict(rows)
    long = [t.split() for _, t in rows if t and 400 < len(t.split()) < 2000 and len(set(t.split())) > 200]
    planted = {}
    for k in range(120):
        source = long[int(rng.integers(len(long)))]
        at = int(rng.integers(len(source) - 70))
        passage = " ".join(source[at : at + int(rng.integers(55, 70))])
        for i in rng.choice(len(rows), 3, replace=False):
            doc_id, words = rows[i][0], (texts[rows[i][0]] or "").split(" ")
            if doc_id not in planted:
                where = int(rng.integers(len(words) + 1))
                texts[doc_id] = " ".join([*words[:where], passage, *words[where:]])
                planted[doc_id] = k
    first, seen, clean = {}, set(), []
    for i, t in sorted(texts.items()):
        here = windows(t)
        if i in planted:
            first.setdefault(planted[i], i)
        elif not here & seen:
            clean.append(i)
        seen |= here
    got = cut(spark, texts)
    later = [i for i, k in planted.items() if first[k] != i]
    assert len(later) > 150 and len(clean) > 500
    assert np.mean([bool(got[i][1]) for i in later]) >= 0.95
    assert np.mean([not got[i][1] for i in clean]) >= 0.95
