"""Registered queries of the subpackage on tables of their own."""

import re

from gleaner.llm import queries


def test_all_spam_hosts(spark, sf_dir, tmp_path):
    made = [f"http://{sub}{f}.{d}{tail}" for sub in ("", "m.") for f in ("casino-win", "free-bets", "cheap-pills", "adult-x", "ads-track", "spam-farm") for d in ("example.com", "example.net", "example.org") for tail in ("", "?x", "/", "/a")]
    given = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    urls = made + given + ["http://not-ads-track.example.com/a", "http://ads-track.example.edu/", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op8_urls(spark, str(tmp_path)).collect()}
    assert len(got) == len(urls)
    spam = re.compile(r"^([^.]+\.)*(casino-win|free-bets|cheap-pills|adult-x|ads-track|spam-farm)\.example\.(com|net|org)$")
    for i, u in enumerate(urls):
        rest = re.match(r".*?://(.*)", u or "", re.S)
        host = re.split("[/?#]", rest[1] if rest else "", maxsplit=1)[0].lower()
        assert got[i].host == host
        if got[i].rule is None:
            assert got[i].verdict == ("block" if spam.match(host) else "allow"), u
    assert sum(got[i].verdict == "block" for i in range(len(made)) if got[i].rule is None) > 40


def test_chat_of_a_null_conversation(spark, tmp_path):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (None, 2, "user", "r"), (3, 0, "user", "x"), (3, 1, "assistant", "yy")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in queries.op4_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 3, -7} and got[None] == (3, 1) and got[3] == (2, 2)


def test_mixing_by_broadcast_or_salted_join(spark, monkeypatch):
    from gleaner.llm import mixing

    # Keys that repeat, null ones among them, so that cuts fall into rows of one hash.
    rows = [(None if i % 3 == 0 else i % 40, f"{'w ' * (1 + i % 3)}x{i}", "ab"[i % 7 == 0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = []
    for most in (mixing.BROADCAST_GROUPS, 0):
        monkeypatch.setattr(mixing, "BROADCAST_GROUPS", most)
        found.append(sorted((r.text, r.size, r.target, r.copies) for r in mixing.mix(docs).collect()))
    assert found[0] == found[1] and [f[0] for f in found[0]] == sorted(r[1] for r in rows)
    source = {text: s for _, text, s in rows}
    for s in "ab":
        mine = [f for f in found[0] if source[f[0]] == s]
        assert abs(sum(f[1] * f[3] for f in mine) - mine[0][2]) <= max(f[1] for f in mine)
