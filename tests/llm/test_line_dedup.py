import collections
import hashlib

import duckdb

from ledgerline.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_docs=10, min_chars=1):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    count = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


def test_edges(docs_of):
    shared = "Menu Home"
    rows = [(k, f"line {k}\n {shared.upper()}\t\nend\n") for k in range(12)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, shared), (None, shared), (23, "É"), (24, "é"), (25, shared + "\n" + shared)]
    rows += [(26, f"{shared}\nkeep\n{shared}\nkeep too\r\n{shared}"), (27, "\x1fmenu home")]
    out = line_dedup.dedup_lines(docs_of(rows, extra=["n_lines", "__other"]))
    assert out.columns == ["doc_id", "text", "__other", "n_lines", "n_dropped"]
    assert got(out) == brute(rows)


def test_repeated_rows_are_documents(docs_of):
    rows = [(1, "same\nline")] * 10
    assert got(line_dedup.dedup_lines(docs_of(rows))) == brute(rows) == [(1, 2, 2, "")] * 10


def test_common_and_rare_lines_take_both_ways(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_HOT", 20)
    rows = [(k, f"in all\n{'in some' if k < 15 else 'x'}\nown {k}\nIN ALL ") for k in range(40)]
    assert got(line_dedup.dedup_lines(docs_of(rows))) == brute(rows)
    monkeypatch.setattr(line_dedup, "LEAST_HOT", 1)
    assert got(line_dedup.dedup_lines(docs_of(rows))) == brute(rows)


def test_min_chars(docs_of):
    rows = [(k, f"ab\nabc\nx{k}") for k in range(10)]
    assert got(line_dedup.dedup_lines(docs_of(rows), min_chars=3)) == brute(rows, min_chars=3)


def test_long_text_with_many_dropped_lines(docs_of):
    many = "\n".join(["common", "rare"] * 20_000)
    rows = [(k, "common\n" + "x" * k) for k in range(10)] + [(99, many)]
    assert got(line_dedup.dedup_lines(docs_of(rows))) == brute(rows)


def test_empty_table(docs_of):
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_query_against_sql(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(duckdb.sql(line_dedup.OP5_SQL).fetchall())
    out = line_dedup.op5_line_dedup(spark, small)
    assert sorted(map(tuple, out.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want


def test_digest_of_kept_text(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows))
    assert sorted(map(tuple, line_dedup.op5_line_dedup(spark, tiny).collect())) == want


def test_no_python_in_any_plan(spark, tiny, monkeypatch):
    plans = []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, f=line_dedup.materialize: plans.append(df._jdf.queryExecution().toString()) or f(df))
    plans.append(line_dedup.op5_line_dedup(spark, tiny)._jdf.queryExecution().toString())
    assert len(plans) == 2 and all("Python" not in p and "Arrow" not in p and "RDD" not in p for p in plans)


def test_columns_of_internal_names_come_back(spark):
    names = ["__k1", "__k2", "__text", "__drops", "c0", "__h1", "__hot", "n_lines"]
    df = spark.createDataFrame([(k, "common\nown " + str(k), *["v"] * len(names)) for k in range(12)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    rows = line_dedup.dedup_lines(df).collect()
    assert sorted(r.text for r in rows) == sorted(f"own {k}" for k in range(12))
    assert all(r[n] == "v" for r in rows for n in names if n != "n_lines") and all((r.n_lines, r.n_dropped) == (2, 1) for r in rows)
