"""Measures, host rates and verdicts against plain loops."""

from collections import Counter

import odd
import pytest

from frameglass.llm import quality


def plain_measures(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(lines), sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text),
    )


MORE = [
    "a b c d e f g h " * 2, "a " * 7, "a " * 8, "a " * 9, "one\ntwo\none\n\n\none \n", "é" * 30 + " \x85", " ".join("abcdefghij" * 3),
    " ".join(f"w{i % 40}" for i in range(500)), " ".join(f"w{i}" for i in range(30)) + " x " + " ".join(f"w{i}" for i in range(9, 18)),
]


@pytest.mark.parametrize("text", odd.TEXTS + MORE)
def test_measures(text):
    assert quality.measure((text or "").encode()) == plain_measures(text)


def test_windows_with_equal_hashes_stay_apart(monkeypatch):
    class Same(bytes):
        def __hash__(self):
            return 1

    words = [Same(w.encode()) for w in ("a b c d e f g h i j k l m n o p q a b c d e f g h".split())]
    assert quality.repeated_words(words) == 16


CLEAN = " ".join(f"word{i}" for i in range(60))
SOFT = CLEAN + " # # # # # # # # # #"  # 10 symbols in 70 words
HARD = CLEAN + " #" * 60


def host_docs(spark):
    rows, i = [], 0
    plan = {"bad": (30, 20), "good": (400, 4), "tiny": (0, 1), None: (50, 0)}
    for host, (clean, soft) in plan.items():
        for text in [CLEAN] * clean + [SOFT] * soft + [HARD, "short", None]:
            rows.append((i, text, "en", host, 0))
            i += 1
    return odd.clashing(spark.createDataFrame(rows, odd.DOCS).repartition(4)), rows


def test_hosts_decide_between_the_limits(spark):
    df, rows = host_docs(spark)
    kept = {r.doc_id: r.kept for r in quality.verdicts(df).collect()}
    for i, text, _, host, _ in rows:
        assert kept[i] == (text == CLEAN or (text == SOFT and host in ("good",))) or (host == "tiny" and text == SOFT)
    out = quality.keep_good(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {i for i, k in kept.items() if k}


def test_rates_are_shrunk_to_the_beta_prior(spark):
    df, rows = host_docs(spark)
    measured = quality._measured(df, "text", "source", quality.SOFT_RULES)
    got = {(r.host, r.rule): r for r in quality.host_rates(measured).collect()}
    n, f = Counter(r[3] for r in rows), Counter(r[3] for r in rows if r[1] in (SOFT, HARD))
    total = sum(n.values())
    mean = sum(f.values()) / total
    between = sum(f[h] ** 2 / n[h] for h in n) / total - mean**2 - len(n) * mean * (1 - mean) / total
    strength = mean * (1 - mean) / between - 1
    for h in n:
        assert got[h, "symbols"].shrunk == pytest.approx((f[h] + mean * strength) / (n[h] + strength))
    assert got["bad", "symbols"].bad and not got["good", "symbols"].bad
    assert abs(got["tiny", "symbols"].shrunk - mean) < abs(got["tiny", "symbols"].rate - mean)


def test_odd_rows_and_nothing(spark):
    got = {r.doc_id: r for r in quality.verdicts(odd.clashing(odd.docs(spark, 2))).collect()}
    assert len(got) == 2 * len(odd.TEXTS) and not got[0].kept and got[0].base_failed
    assert all(tuple(got[i])[1:9] == plain_measures(t) for i, t, *_ in odd.rows(2))
    assert quality.verdicts(odd.docs(spark).limit(0)).count() == 0 and quality.keep_good(odd.docs(spark).limit(0)).count() == 0


def test_planted_hosts_are_rejected_by_query_and_sql(spark, tmp_path):
    """`noisy` fails a soft rule often, `broken` the base rules, `few` too seldom to know; the rest is clean."""
    import duckdb

    from frameglass.llm.queries import ORACLE, op5_host_rules

    plan = {"noisy": (40, 25, 0), "broken": (40, 3, 30), "few": (1, 1, 1), "fine": (300, 6, 3), None: (80, 1, 0)}
    rows = [(host, text) for host, counts in plan.items() for text, n in zip((CLEAN, SOFT, "short"), counts) for _ in range(n)]
    docs = spark.createDataFrame([(i, text, "en", host, 0) for i, (host, text) in enumerate(rows)], odd.DOCS)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kept for r in op5_host_rules(spark, str(tmp_path)).collect()}
    assert got == {i: text == CLEAN or (text == SOFT and host in ("few", "fine", None)) for i, (host, text) in enumerate(rows)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(f"SELECT doc_id, kept FROM ({ORACLE['op5_host_rules']}) q").fetchall())
