"""The bound of op 6's contract: 400 bytes, however many words they are."""

from candlemill.llm import substrings


def test_a_passage_goes_from_400_bytes_on(spark):
    """A shared passage of 57 words stays at 399 bytes and goes as a whole at 400; the pipeline's rule of 51 words cuts both."""
    rows = []
    for k, size in enumerate((399, 400)):
        passage = " ".join(f"w{k}{i:03}x" for i in range(56))
        passage += " " + "z" * (size - len(passage) - 1)
        assert len(passage) == size and len(passage.split()) == 57
        rows += [(10 * k + j, f"{'ab'[j] * 30} start{k}{'ab'[j]}{passage}{'cd'[j]} end{k}") for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.summary(df).collect()}
    size = {d: len(t) for d, t in rows}
    assert got == {0: (size[0], 0, 0), 1: (size[1], 0, 0), 10: (size[10], 400, 1), 11: (size[11], 400, 1)}
    assert {r._spans for r in substrings.remove(df, passage=51).collect()} == {1}
