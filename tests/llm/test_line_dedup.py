import duckdb

from pagequarry.llm import line_dedup, queries


def brute(docs):
    """docs: ordered (id, text), ids distinct."""
    seen, gone = {}, {}
    for i, text in docs:
        lines = text.split("\n") if text is not None else []
        for p in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[p : p + 3]), (i, p)) != (i, p):
                gone.setdefault(i, set()).update((p, p + 1, p + 2))
    return {i: (len(t.split("\n")) if t is not None else 0, len(gone.get(i, ())), None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ()))) for i, t in docs}


def test_small_cases(documents):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\nd\ny", "a\nb", None, "", "b\nc\nd", "q\nq\nq\nq\nq", "a\nb\nc\n", "é\n\n\n\né", "b\nc\nd\nb\nc\nd"]
    docs = documents(texts, clash=True)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_report(docs).collect()}
    assert got == brute(list(enumerate(texts)))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, (_, _, t) in got.items()}


def test_odd_rows(odd):
    out = line_dedup.dedup_lines(odd)
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert line_dedup.line_report(odd.limit(0)).count() == 0


def test_rows_without_an_id_come_first(documents):
    docs = documents(["a\nb\nc", "a\nb\nc"], ids=[5, None])
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {5: "", None: "a\nb\nc"}


def test_query_matches_brute_force_and_sql(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in queries.op8_line_dedup(spark, sf_dir).collect()}
    assert got == brute(docs)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op8_line_dedup"]).fetchall()} == got
