"""Host verdicts against the prior's formula written out."""

from crawlgauge.llm import quality_rules as Q

from . import helpers as H


def test_hosts_are_flagged_by_shrunk_rates(spark):
    clean = [H.words(80, i) for i in range(200)]
    junk = [" ".join(w + "###" for w in H.words(80, 500 + i).split()) for i in range(40)]
    rows = [(i, t, f"host{i % 10}") for i, t in enumerate(clean)]
    rows += [(1000 + i, t, "spam") for i, t in enumerate(junk[:30])] + [(2000, clean[0] + " other", "spam"), (2001, junk[30], "host1"), (2002, junk[31], "tiny"), (2003, junk[32], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hosts = {}
    for _, t, h in rows:
        n, f = hosts.get(h or "", (0, 0))
        hosts[h or ""] = (n + 1, f + ("#" in t))
    total, failed = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values())
    mean = failed / total
    between = sum(f * f / n for n, f in hosts.values()) / total - mean * mean - mean * (1 - mean) * len(hosts) / total
    strength = mean * (1 - mean) / between - 1
    rate = {h: (f + mean * strength) / (n + strength) for h, (n, f) in hosts.items()}
    stats = Q.with_stats(docs)
    from pyspark.sql import functions as F

    got = {r["host"]: r["rate"] for r in Q.host_rates(stats, F.coalesce(F.col("row.source"), F.lit(""))).where("rule = 'symbols'").collect()}
    assert got.keys() == rate.keys() and all(abs(got[h] - rate[h]) < 1e-9 for h in rate)
    assert rate["spam"] > Q.HOST_LIMIT > rate["host1"]
    kept = {r["row"]["doc_id"]: r["kept"] for r in Q.judge(docs).collect()}
    assert not any(kept[1000 + i] for i in range(30)) and kept[2000] and kept[2001]
    assert all(kept[i] for i in range(200)) and kept[2002] == (rate["tiny"] <= Q.HOST_LIMIT)


def test_each_rule_and_measure():
    assert Q.measure("a b c a b c\nx\n x\nx\n\n") == (9, 9, 0, 4, 1, 6)
    assert Q.measure("é€ #*$%&|<>") == (2, 10, 8, 1, 0, 0)
    assert Q.repeated_words(b"a a a a".split()) == 4 and Q.repeated_words(b"a b a".split()) == 0
