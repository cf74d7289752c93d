"""Templates of deep paths, and of branches that are merged with similar ones."""

from shelfspark.llm.url_filter import judged_urls


def test_numbers_below_a_deep_folder_share_its_verdict(spark):
    rules = [("block", "deep.org/a/b/c/bad/1"), ("allow", "deep.org/a/b/c/good/1")]
    urls = [f"http://deep.org/a/b/c/{w}/{n}" for w in ("bad", "good") for n in [1] * 20 + [2] * 5]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {(r["path"], r["verdict"], r["template"]) for r in judged_urls(table, rules).collect()}
    assert got == {(f"/a/b/c/{w}/{n}", v, f"deep.org/a/b/c/{w}/{{n}}") for w, v in [("bad", "block"), ("good", "allow")] for n in (1, 2)}


def test_purity_decides_unlabelled_pages_by_labels_of_their_own(spark):
    """Templates with 18 of 20, 10 of 20 and 3 of 3 bad labels; each has ten pages without a label or rule."""
    rows = []
    for folder, labels in (("spam", [True] * 18 + [False] * 2), ("mixed", [True] * 10 + [False] * 10), ("few", [True] * 3), ("none", [])):
        rows += [(f"http://h.org/{folder}/{i}", label) for i, label in enumerate([*labels, *[None] * 10])]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad boolean")
    got = judged_urls(table, [], bad=table["bad"], z=0.1, purity=0.8).collect()
    assert all(r["rule"] is None for r in got)
    assert {(r["path"].split("/")[1], r["verdict"]) for r in got} == {("spam", "block"), ("mixed", "allow"), ("few", "allow"), ("none", "allow")}


def test_a_branch_without_labels_beside_a_blocked_one_stays_allowed(spark):
    urls = [f"http://b.com/p/q/r/{w}/x{i}" for w in ("k1", "k0") for i in range(20)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {(r["path"].split("/")[4], r["verdict"], r["template"]) for r in judged_urls(table, [("block", "b.com/p/q/r/k1/")]).collect()}
    assert got == {("k1", "block", "b.com/p/q/r/k1/*"), ("k0", "allow", "b.com/p/q/r/k0/*")}


def test_ten_segments(spark):
    urls = [f"http://d.org/1a/b/c/d/e/f/g/h/{w}/{i}" for w in ("bad", "good") for i in range(20)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {(r["path"].split("/")[9], r["verdict"], r["template"]) for r in judged_urls(table, [("block", "d.org/1a/b/c/d/e/f/g/h/bad/")]).collect()}
    assert got == {("bad", "block", "d.org/1a/b/c/d/e/f/g/h/bad/{n}"), ("good", "allow", "d.org/1a/b/c/d/e/f/g/h/good/{n}")}


def test_similar_siblings_are_one_template(spark):
    """Folders a and b have three bad labels each, too few to reject either; c, of good ones, and d, without labels, stay apart."""
    rows = []
    for folder, labels in (("a", [True] * 3), ("b", [True] * 3), ("c", [False] * 12), ("d", [])):
        rows += [(f"http://h.org/{folder}/{i}", label) for i, label in enumerate([*labels, *[None] * (20 - len(labels))])]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad boolean")
    got = {(r["path"].split("/")[1], r["verdict"], r["template"]) for r in judged_urls(table, [], bad=table["bad"], purity=0.75).collect()}
    assert got == {("a", "block", "h.org/a|b/{n}/"), ("b", "block", "h.org/a|b/{n}/"), ("c", "allow", "h.org/c/{n}/"), ("d", "allow", "h.org/d/{n}/")}


def test_names_of_its_own_columns_and_odd_urls(spark):
    rows = [(1, "http://h.org/" + "x" * 100_000, 5, "t"), (1, "http://h.org/" + "x" * 100_000, 5, "t"), (None, "http://h.org" + "/s" * 40, 0, None), (4, None, 1, ""), (5, "", 1, "")]
    table = spark.createDataFrame(rows, "page_id long, url string, labelled long, t string")
    assert sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["verdict"]) for r in judged_urls(table, [("allow", "org/")]).collect()) == [(0, "h.org", 80, "allow"), (1, "h.org", 100_001, "allow"), (1, "h.org", 100_001, "allow"), (4, "", 0, "allow"), (5, "", 0, "allow")]
