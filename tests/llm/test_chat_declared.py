"""A template's declaration that it only appends is checked on whole conversations of any size."""

from pyspark.sql import functions as F

from candlemill.llm import chat


def late(turns, opening):
    """Drops old turns from turn 37 on: no two runs of sixteen turns show it."""
    return "<s>" * opening + "".join(f"[{text}]" for _, text in turns[-36:])


def plain(turns, opening):
    return "<s>" * opening + "".join(f"[{text}]" for _, text in turns)


def conversations(spark, size):
    rows = spark.range(80).selectExpr("id div 40 as conv_id", "id % 40 as turn", "'assistant' as role")
    return rows.filter("conv_id = 1 or turn < 36").withColumn("text", F.repeat(F.lit("x"), size))


def test_chat_declaration_is_checked_at_any_size(spark):
    """Conversations of 400 characters and of 20 MB get the same answer: the one of 40 turns breaks the declaration."""
    for size in (10, 1 << 19):
        df = conversations(spark, size)
        for template, breaks in ((late, True), (plain, False)):
            rows = chat.render(df, template, additive=True).selectExpr("conv_id", "run", "rewrote", "size(turns) as n").collect()
            got = {(r.conv_id, r.run): (r.rewrote, r.n) for r in rows}
            want = {(0, 0): (False, 16), (0, 1): (False, 16), (0, 2): (False, 4)}
            want |= {(1, k): (True, 0) if breaks else (False, n) for k, n in enumerate((16, 16, 8))}
            assert got == want, (size, template)


def test_chat_appending_template_streams(spark):
    """A template made of one turn's function gives runs of at most sixteen turns of any conversation, and true prefixes if asked."""
    df = conversations(spark, 1 << 15)
    whole = {c: chat.instruct([("assistant", "x" * (1 << 15))] * n, True) for c, n in ((0, 36), (1, 40))}
    parts = {}
    for r in sorted(chat.render(df).collect(), key=lambda r: (r.conv_id, r.run)):
        assert len(r.turns) <= chat.RUN and not r.rewrote and all(r.output[s.text_start : s.text_end] == "x" * (1 << 15) for s in r.turns)
        parts.setdefault(r.conv_id, []).append(r.output)
    assert {c: len(p) for c, p in parts.items()} == {0: 3, 1: 3} and {c: "".join(p) for c, p in parts.items()} == whole
    one = chat.render(df, additive=False).collect()
    assert {r.conv_id: (r.output, r.run, r["last"], r.rewrote) for r in one} == {c: (t, 0, True, False) for c, t in whole.items()}
    assert {tuple(r) for r in chat.digests(chat.render(df)).collect()} == {tuple(r) for r in chat.digests(chat.render(df, additive=False)).collect()}
