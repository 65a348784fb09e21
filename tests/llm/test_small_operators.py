"""URL filter and source mixing on small tables."""

from lexiquarry.llm import mixing, url_filter


def test_urls_with_odd_rows(spark):
    urls = {
        1: ("https://WWW.Example.org/es/9?x=1", "www.example.org", "/es/9", "example.org/es/", "block"),
        2: ("https://a.b.org/x", "a.b.org", "/x", "org/", "allow"),
        3: ("http://free-bets.example.com/en/1", "free-bets.example.com", "/en/1", None, "block"),
        4: ("http://alphabets.example.com/en/1", "alphabets.example.com", "/en/1", None, "allow"),
        5: (None, "", "", None, "allow"),
        6: ("no scheme casino", "", "", None, "block"),
        7: ("http://casino.com/fr/1", "casino.com", "/fr/1", "com/fr/", "allow"),
        8: ("http://x.example.net#top", "x.example.net", "", None, "allow"),
        9: ("http://cheap.net/free", "cheap.net", "/free", None, "block"),
        10: ("http://cheap.net/cheap", "cheap.net", "/cheap", None, "allow"),
        11: ("", "", "", None, "allow"),
        12: ("http://example.org", "example.org", "", None, "allow"),
    }
    df = spark.createDataFrame([(k, v[0], "clash") for k, v in urls.items()] + [(None, "x://y/" + "z" * 100_000, "clash")], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    for k, v in urls.items():
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == v[1:], k
    assert len(got[None]["path"]) == 100_001
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_targets_stop_at_the_cap_and_words_come_near(spark):
    rows = [(i, "w " * (1 + i % 50), ["a", "b", "c", None][i % 4] if i % 40 else "tiny", 0) for i in range(2000)]
    rows += [(5000, None, "empty", 0), (5001, " \t", "empty", 0), (None, "x y", "a", 0), (1, rows[1][1], "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").repartition(5)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        s = per.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["taken"]
        s[1] += r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(s[1] for s in per.values())
    assert abs(sum(t for _, t in per) - total) < 1e-6 * total
    for (size, target), (taken, mine) in per.items():
        assert mine == size and target <= 3 * size and abs(taken - target) <= max(60, 0.02 * target)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(df).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.mix_sources(df.limit(0)).count() == 0
