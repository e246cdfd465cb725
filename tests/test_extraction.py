"""The extraction operators against plain loops over the same rows."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgerline.functions import text as x
from ledgerline.operators import extraction as e
from ledgerline.operators import quality, sequences
from ledgerline.plans.compile import ResultContract, unsupported_figures
from ledgerline.plans.guard import dry_run


def match(a, v):
    if a == v:
        return 100.0
    gap = abs(len(a) - len(v))
    if v.startswith(a) or a.startswith(v):
        return 92.0 - gap
    return 86.0 - gap if a in v or v in a else SequenceMatcher(None, a, v).ratio() * 80


def test_best_rows_against_a_loop(spark):
    rng = random.Random(1)
    words = ["cash", "cash and bank", "inventory", "total assets", "assets", "net profit", "profit", "tax paid", ""]
    rows = [(t, r, [rng.choice(words) + rng.choice(["", " x", "s"]) for _ in range(rng.randint(0, 3))]) for t in range(4) for r in range(8)]
    aliases = [("cash", "cash", 0), ("cash", "cash at bank", 1), ("assets", "total assets", 0), ("profit", "net profits", 0)]
    least = {"cash": 60.0}
    want = set()
    for t, r, variants in rows:
        for f in {a[0] for a in aliases}:
            found = [(-match("".join(a.split()), "".join(v.split())), p, k, a, v) for k, v in enumerate(variants) for g, a, p in aliases if g == f and "".join(v.split())]
            if found and -min(found)[0] >= least.get(f, 68.0):
                s, _, _, a, v = min(found)
                want.add((t, r, f, a, v, round(-s, 6)))
    out = e.best_rows(spark.createDataFrame(rows, "table_id int, row_id int, variants array<string>"), spark.createDataFrame(aliases, "field string, alias string, position int"), least).collect()
    assert {(o.table_id, o.row_id, o.field, o.alias, o.variant, round(o.score, 6)) for o in out} == want
    for t in range(4):
        for f in ("cash", "assets", "profit"):
            own = sorted((o for o in out if o.table_id == t and o.field == f), key=lambda o: o.place)
            assert [o.place for o in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda o: (-o.score, o.row_id))


def test_suggestions(spark):
    rows = [("total assets", "12 13"), ("tax", ""), ("", ""), ("assets", "of which total")]
    df = spark.createDataFrame(rows, "a string, b string").select(e.suggestion_score(F.col("a"), F.col("b"), F.lit("total assets"), ["of which", "none"]).alias("s"))
    assert [r.s for r in df.collect()] == [1.0, round(SequenceMatcher(None, "total assets", "tax").ratio(), 6), 0.0, round(SequenceMatcher(None, "total assets", "assets").ratio(), 6)]


def test_page_breaks_against_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for f in range(20):
        for p in range(1, 5):
            for y in range(rng.randint(1, 3)):
                rows.append((f, p, y, rng.choice(["", "cash", "a long item name"]), {c: str(rng.randint(1, 9)) for c in rng.sample("ab", rng.randint(0, 2))}))
    df = spark.createDataFrame(rows, "file_id int, page_no int, y int, item string, cells map<string,string>")
    got = sorted((r.file_id, r.page_no, r.y, r.item, sorted(r.cells.items())) for r in sequences.merge_page_breaks(df).collect())
    want, held = [], None
    for file, page, y, item, cells in sorted(rows, key=lambda r: r[:3]):
        if held is not None and held[0] == file and page == held[1] + 1 and held[3]:
            no_name, first_has_no_amount, both_short = not item and cells, item and not held[4] and cells, item and not cells and len(held[3]) <= 8 and len(item) <= 12
            if no_name or first_has_no_amount or both_short:
                held = (file, held[1], held[2], held[3] + item, {**cells, **held[4]})
                continue
        if held is not None:
            want.append(held)
        held = (file, page, y, item, cells)
    want.append(held)
    assert got == sorted((f, p, y, i, sorted(c.items())) for f, p, y, i, c in want)


def test_backfill_twice_is_once(spark):
    have = spark.createDataFrame([(1, "bs", "f", "manual_backfill", "old"), (1, "bs", "f", "rule", "5"), (2, "bs", "f", "manual_backfill", "keep")], "file_id long, target_table string, field string, extract_method string, value_text string")
    sheet = spark.createDataFrame([(2, "1", "bs", "f", "7"), (3, "1", "bs", "f", " 8 "), (4, "x", "bs", "f", "9"), (5, "2", "bs", "", "9"), (6, "2", "bs", "bs.id", "1"), (7, "2", "bs", "g", "")], "line_no int, file_id string, target_table string, field string, manual_value string")
    assert [r.reason for r in e.check_backfill(sheet, skipped=["id"]).orderBy("line_no").collect()] == ["", "", "bad_file_id", "missing_field", "metadata_field", "empty_value"]
    once = e.backfill(have, sheet, ["id"])
    want = [(1, "bs", "f", "manual_backfill", "8"), (1, "bs", "f", "rule", "5"), (2, "bs", "f", "manual_backfill", "keep")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, e.backfill(once, sheet, ["id"]).collect())) == want


def test_mapping_audit(spark):
    columns = spark.createDataFrame([("t", "total_revenue"), ("t", "net_profit")], "table string, column string")
    wanted = spark.createDataFrame([("t", "a", "net_profit", "x"), ("t", "b", "net_profits", "x"), ("t", "c", "qq", "x"), ("t", "d", None, "derived_metric"), ("u", "e", "net_profit", "x")], "table string, field string, source_field string, kind string")
    got = {r.field: (r.exists, r.possible, r.action) for r in quality.mapping_audit(wanted, columns).collect()}
    assert got == {"a": (True, None, ""), "b": (False, "net_profit", "map_to_existing_field"), "c": (False, None, "add_final_table_column"), "d": (False, None, "mark_as_derived_metric"), "e": (False, None, "add_final_table_column")}


def test_display_and_exchange(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(x.display(F.lit(1234567890.0), "yuan")) == "12.35 亿元" and one(x.display(F.lit(0.1234), "fraction")) == "12.34%" and one(x.display(F.lit(None), "percent")) == "-"
    assert one(x.exchange(F.lit("C:\\x\\SH\\a.pdf"), F.lit(""))) == "SSE" and one(x.exchange(F.lit("a"), F.lit("深圳证券交易所"))) == "SZSE" and one(x.exchange(F.lit("a"))) is None
    assert [one(c) for c in x.report_kind(F.lit("某公司 2023 年半年度报告摘要"))] == ["HY", 2023, True]
    assert one(x.clean_row_label(F.lit("12/30（一）其中：减：所得税 费用 附注五、12 1,234.00"))) == "所得税费用"


def test_answers_and_contracts(spark):
    rows = [{"stock_code": "000003", "value": 1234567890.0, "rate": 0.1234, "year": 2020}]
    assert unsupported_figures("000003 made 12.35 in 2020, up 12.34%", rows) == []
    assert unsupported_figures("000003 made 99 and 1,234", rows) == ["99", "1234"]
    contract = ResultContract.of(spark.sql("SELECT 'a' AS stock_code, 1.0 AS net_profit, 2.0 AS roe"), 5)
    assert contract.kinds == {"net_profit": "currency", "roe": "percentage"} and contract.truncated(5) and not contract.truncated(4)


def test_dry_run(spark):
    spark.range(100).createOrReplaceTempView("numbers")
    columns, rows = dry_run(spark, "SELECT id FROM numbers", {"numbers"})
    assert columns == ["id"] and len(rows) == 5
