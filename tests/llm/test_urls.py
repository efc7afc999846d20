"""The template tree decides where no rule does."""

from lexisim.llm import queries, url_filter


def verdicts(spark, rules, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r["page_id"]]: r["verdict"] for r in url_filter.judge(pages, rules).collect()}


def test_pages_without_a_rule_are_blocked(spark):
    got = queries.op8_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_agreeing_siblings_speak_for_a_branch(spark):
    urls = [f"http://a.org/{head}/{k}" for head in ("x", "y", "z") for k in range(20)]
    two = [("block", "a.org", "/x/"), ("block", "a.org", "/y/")]
    assert verdicts(spark, two, urls)["http://a.org/z/1"] == "block"
    assert verdicts(spark, two[:1], urls)["http://a.org/z/1"] == "allow"  # one branch tells nothing of its siblings
    assert verdicts(spark, [two[0], ("allow", "a.org", "/y/")], urls)["http://a.org/z/1"] == "allow"
    other = urls[:40] + [f"http://a.org/z/{k}/read/on" for k in range(40)]  # another spread over paths
    assert verdicts(spark, two, other)["http://a.org/z/1/read/on"] == "allow"


def test_deep_paths_are_told_apart(spark):
    urls = [f"http://b.org/a/b/c/d/e/f/{leaf}/{k}" for leaf in ("spam", "news") for k in range(30)]
    got = verdicts(spark, [("block", "b.org", "/a/b/c/d/e/f/spam/1")], urls)
    assert got["http://b.org/a/b/c/d/e/f/spam/5"] == "block" and got["http://b.org/a/b/c/d/e/f/news/5"] == "allow"
