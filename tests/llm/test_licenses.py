"""License scans against plain loops over all windows and templates."""

import random
import re

import odd
import pytest

from frameglass.llm import licenses

SEP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return [w for w in SEP.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def plain(text, containment):
    words = words_of(text)
    places, base, found, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    for t in licenses.templates():
        for start in range(0, len(words), t.stride):
            shared = len(t.distinct & set(words[start : start + 2 * t.stride]))
            if shared >= t.least(containment):
                found.add(t.label)
                best = max(best, shared / len(t.distinct))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)), 1.0 if base else best)


def licence_texts():
    random.seed(9)
    out = []
    for k in range(120):
        words = odd.sentence(k, random.randrange(5, 400)).split(" ")
        for _ in range(random.randrange(3)):
            _, text = random.choice(licenses.TEMPLATES)
            piece = [w for w in text.split() if random.random() > 0.05 * (k % 4)]
            if k % 5 == 0:
                random.shuffle(piece)
            at = random.randrange(len(words))
            words[at:at] = piece
        out.append(" ".join(words))
    return out + [t for _, t in licenses.TEMPLATES] + ["cc by nc " * 5, "CC-BY-NC cc by", "under the mit", "x" + "under the mit license"]


@pytest.mark.parametrize("containment", [0.6, 0.9, 1.0])
def test_equals_all_windows(spark, containment):
    rows = odd.rows() + [(1_000 + i, t, None, None, 0) for i, t in enumerate(licence_texts())]
    df = odd.clashing(spark.createDataFrame(rows, odd.DOCS).repartition(4))
    got = {r.doc_id: tuple(r)[1:] for r in licenses.labels(df, containment=containment).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        expected = plain(t, containment)
        assert got[i][:6] == expected[:6] and got[i][6] == pytest.approx(expected[6]), t


def test_templates_and_order():
    t = licenses.templates([("a", "One two, TWO"), ("b", " .,")])
    assert [x.words for x in t] == [("one", "two", "two")] and t[0].least(0.9) == 2 and t[0].stride == 8


def test_blocks_are_real_outputs(spark):
    text = "a " * 50 + "Released under the MIT License. " + "b " * 50
    _, met = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = met.collect()
    assert {r.label for r in rows} == {"mit"} and all(r["first"] <= 50 < r["first"] + r.words for r in rows)


def test_repeats_null_ids_and_nothing(spark):
    rows = [(None, "under the MIT license"), (None, "x"), (1, "Licensed under CC BY-NC 4.0"), (1, "Licensed under CC BY-NC 4.0"), (1, "y")]
    got = licenses.labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in got) == [(0, ""), (0, "mit"), (1, ""), (1, "cc-by-nc"), (1, "cc-by-nc")]
    assert licenses.labels(odd.docs(spark).limit(0)).count() == 0
    assert {r.labels for r in licenses.labels(odd.docs(spark), texts=(), phrases={}).collect()} == {""}
