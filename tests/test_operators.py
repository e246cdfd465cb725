import pytest
from pyspark.sql import functions as F

from ledgerline.functions import similarity
from ledgerline.functions import text as x
from ledgerline.operators import load, matching, quality, sequences


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize(
    "make,value,want",
    [
        (x.normalise_text, "　a\xa0b\r\nc ", "a b\nc"),
        (x.normalise_text, None, ""),
        (x.compact_text, " a　b\n", "ab"),
        (x.normalise_item_name, "一、营业收入", "营业收入"),
        (x.normalise_item_name, "其中：货币资金", "货币资金"),
        (x.normalise_item_name, "（一）资产 合计：", "资产总计"),
        (x.normalise_item_name, "减：所得税费用", "所得税费用"),
        (x.clean_row_label, "流动资产：货币资金 附注五、1 1,234.50", "货币资金"),
        (x.normalise_stock_code, " 123.0", "000123"),
        (x.normalise_stock_code, "AB 12", "AB12"),
        (x.normalise_period, "h1", "HY"),
        (x.normalise_period, "Annual ", "FY"),
        (x.normalise_period, None, None),
        (x.detect_unit, "单位：万元 币种：人民币", "万元"),
        (x.detect_unit, "nothing", ""),
        (lambda c: x.parse_amount(c).cast("double"), "1,234.50", 1234.5),
        (lambda c: x.parse_amount(c).cast("double"), "（12.5）", -12.5),
        (lambda c: x.parse_amount(c).cast("double"), "－3", -3.0),
        (lambda c: x.parse_amount(c).cast("double"), "45.6 %", 45.6),
        (x.parse_amount, "不适用", None),
        (x.parse_amount, "--", None),
        (x.parse_amount, "abc", None),
        (lambda c: x.numeric_tokens(c), "a 1,200 and (3.5) 7%", ["1,200", "(3.5)", "7%"]),
        (lambda c: x.period_role(c), "期末余额", "current"),
        (lambda c: x.period_role(F.lit(""), c), "上年末余额 期末", "previous"),
        (lambda c: x.period_role(c), "列", "unknown"),
        (lambda c: x.column_role(c, F.lit(2024)), "2023 年", "previous"),
        (lambda c: x.column_role(c, F.lit(2024)), "附注", "note"),
        (lambda c: x.json_field(c, "a"), "{bad", None),
        (lambda c: x.json_field(c, "a"), '{"a": 3}', "3"),
        (lambda c: x.report_kind(c)[0], "某公司2023年半年度报告", "HY"),
        (lambda c: x.report_kind(c)[1].cast("string"), "某公司2023年年度报告", "2023"),
    ],
)
def test_text(spark, make, value, want):
    assert one(spark, value, make) == want


def test_scaled_amount(spark):
    assert float(one(spark, "12.345", lambda c: x.scale_amount(x.parse_amount(c), F.lit("万元")))) == 123450.0


def test_aliases(spark):
    df = spark.createDataFrame([("000001", "甲", "甲乙（中国）股份有限公司")], "a string, b string, c string")
    got = [(r["alias"], r["kind"], r["is_primary"]) for r in df.select(x.alias_names(F.col("a"), F.col("b"), F.col("c")).alias("v")).first().v]
    assert ("甲乙（中国）", "company_name_short", False) in got and ("甲乙(中国)股份有限公司", "company_name", False) in got
    assert len(got) == len({g[:2] for g in got})


@pytest.mark.parametrize("a,b,want", [("现金", "现金", 100.0), ("现金", "现金流量", 90.0), ("流量", "现金流量表", 83.0), ("", "x", 0.0)])
def test_containment(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(similarity.row_match_score(F.col("a"), F.col("b"))).first()[0] == want


def test_similarity(spark):
    df = spark.createDataFrame([("net_profit", "profit_net"), ("abcd", "abxd")], "a string, b string")
    s = [r[0] for r in df.select(similarity.field_similarity(F.col("a"), F.col("b"))).collect()]
    assert s == [1.0, 0.75]


T = "k int, v string, w int"


def test_upserts(spark):
    target, source = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], T), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, load.upsert(target, source, ["k"]).collect())) == [(1, "a", 1), (2, "B", 2), (3, "C", None)]
    assert sorted(map(tuple, load.insert_ignore(target, source.withColumn("w", F.lit(9)), ["k"]).collect())) == [(1, "a", 1), (2, "b", 2), (3, "C", 9)]
    assert sorted(map(tuple, load.partial_update(target, source.withColumn("w", F.lit(None).cast("int")), ["k"]).collect())) == [(1, "a", 1), (2, "B", 2)]
    assert [r.k for r in load.delete_keys(target, source, ["k"]).collect()] == [1]
    assert sorted(r.k for r in load.replace_slice(target, source.withColumn("w", F.lit(2)), ["w"]).collect()) == [1, 2, 3]


def test_store_replaces_partitions(spark, tmp_path):
    load.store(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], T), str(tmp_path / "t"), ["w"])
    load.store(spark.createDataFrame([(3, "c", 2)], T), str(tmp_path / "t"), ["w"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 3]


def test_stage_rule(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 2), ("b", 0.9, 1), ("b", 0.87, 2), ("c", 0.7, 1), ("d", 0.7, 1), ("d", 0.6, 2), ("e", 0.5, 1)]
    got = {r.f: r.stage for r in load.stage_of(spark.createDataFrame(rows, "f string, confidence double, file_id int"), ["f"]).collect()}
    assert got == {"a": "rule", "b": "needs_rerank", "c": "candidate_fill", "d": "needs_rerank", "e": "needs_rerank"}


def test_identities(spark):
    kind = "stock_code string, report_year int, report_period string, asset_total_assets decimal(20,2), liability_total_liabilities decimal(20,2), equity_total_equity decimal(20,2), liability_and_equity_total decimal(20,2)"
    from decimal import Decimal as D

    rows = [("a", 1, "FY", D(100), D(60), D(40), D(100)), ("b", 1, "FY", D(100), D(60), D(40), D(150)), ("c", 1, "FY", D(100), D(60), D(50), None), ("d", 1, "FY", D(100), None, D(1), None), ("e", 1, "FY", D(100), None, None, D("100.5"))]
    got = {r.stock_code: (r.mode, r.status) for r in quality.balance_identity(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": ("stated_total", "passed"), "b": ("fallback_to_parts", "passed"), "c": ("sum_of_parts", "failed"), "d": ("skipped", "skipped"), "e": ("stated_total", "passed")}
    cash = spark.createDataFrame([("a", 1, "FY", 1.0, 1.0, 1.0, 3.0, 0.0), ("b", 1, "FY", 1.0, 1.0, 1.0, 4.0, 1.0), ("c", 1, "FY", None, 1.0, 1.0, 4.0, 1.0)], "stock_code string, report_year int, report_period string, operating_cf_net_amount double, investing_cf_net_amount double, financing_cf_net_amount double, net_cash_flow double, fx double")
    assert {r.stock_code: r.status for r in quality.cash_identity(cash).collect()} == {"a": "warning", "b": "failed", "c": "skipped"}
    assert {r.stock_code: r.status for r in quality.cash_identity(cash, "fx").collect()} == {"a": "passed", "b": "passed", "c": "skipped"}
    assert {r.stock_code: r.rejections for r in quality.plausible_cash(cash).collect()} == {"a": "three_equal_amounts", "b": "three_equal_amounts", "c": ""}


def test_clusters_follow_the_running_centre(spark):
    rows = spark.createDataFrame([(1, v) for v in (0.0, 2.0, 3.5, 9.0, 10.0)], "page int, y double")
    assert [r.cluster for r in sequences.cluster_lines(rows, ["page"], "y", 2.8).orderBy("y").collect()] == [0, 0, 0, 1, 1]


def test_label_pairs(spark):
    rows = spark.createDataFrame([(1, 1, "total", None), (1, 2, " assets", "5"), (1, 3, "cash", "2"), (1, 4, "end", None)], "page int, n int, label string, value string")
    got = [(r.label, r.value) for r in sequences.merge_labels(rows, ["page"], "n", "label", "value").orderBy("n").collect()]
    assert got == [("total assets", "5"), ("cash", "2"), ("end", None)]


def test_first_nonempty(spark):
    rows = spark.createDataFrame([("a", 1, "", "x"), ("a", 2, "y", "z")], "k string, n int, p string, q string")
    assert tuple(sequences.first_nonempty(rows, ["k"], "n", ["p", "q"]).first()) == ("a", "y", "x")


def test_repeated_lines(spark):
    rows = spark.createDataFrame([("f", p, s) for p in range(4) for s in ("head", f"body {p}")] + [("f", 1, "twice"), ("f", 2, "twice")], "g string, page int, line string")
    assert [r.line for r in sequences.repeated_lines(rows, "g", "page", "line").collect()] == ["head"]


def test_contained_items_with_and_without_inner_words(spark):
    texts = spark.createDataFrame([(1, "xabc defy and so on"), (2, "the quick brown fox"), (3, None), (4, ""), (5, "a  b")], "doc_id long, text string")
    items = [(1, "abc def"), (2, "quick brown fox"), (3, "he quick brow"), (4, "zz"), (5, ""), (6, None), (7, "a  b"), (8, "f"), (9, "brown the quick")]
    out = matching.contained_items(texts, spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d, t in [(r.doc_id, r.text) for r in texts.collect()] for i, x in items if t is not None and x and x in t}
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_files_by_code_then_longest_alias(spark):
    aliases = spark.createDataFrame([("Alpha", "000001"), ("Alpha Beta", "000002"), ("Gamma", "000003"), ("Delta", "000004"), ("gamma", "000005"), ("", "000006")], "alias string, stock_code string")
    names = ["alpha beta 2020.pdf", "ALPHA.pdf", "gamma.pdf", "600000_alpha.pdf", "000004 alpha.pdf", "nothing", None, "delta alpha"]
    files = spark.createDataFrame(list(enumerate(names)), "file_id long, file_name string")
    got = {r.file_id: (r.stock_code, r.match_status) for r in matching.match_files(files, aliases).collect()}
    assert got == {0: ("000002", "matched"), 1: ("000001", "matched"), 2: (None, "ambiguous"), 3: ("000001", "matched"), 4: ("000004", "matched"), 7: (None, "ambiguous")}


def test_no_nested_loops(spark):
    from ledgerline.plans import catalog_operators

    for name in ("text_contained_items", "text_match_files", "dq_expected_missing"):
        plan = catalog_operators.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


_DICTIONARY = [("ring", "ring", 0), ("ring", "small  ring", 0), ("size", "Small", 4), ("size", "small", 5), ("profit", "净利润", 1), ("profit", "利润", 1), ("tie", "cash", 2), ("also", "cash", 2), ("none", "", 0), ("none", None, 0)]
_QUESTIONS = [(1, "a small ring"), (2, "Small sma ll"), (3, "净 利润 and 利润 of ring"), (4, "cash\t"), (5, ""), (6, None), (7, "ring"), (7, "small"), (8, "nothing"), (None, "cash")]


def _named(dictionary, questions):
    """(key, metric, alias, place) by a loop."""
    hits = {}
    for k, t in questions:
        for m, a, p in dictionary:
            if (short := "".join((a or "").split())) and short in "".join((t or "").split()):
                hits.setdefault(k, {}).setdefault(m, []).append((-len(short), p, a))
    return {(k, m, min(x)[2], place) for k, of in hits.items() for place, (m, x) in enumerate(sorted(of.items(), key=lambda i: (min(i[1])[:2], i[0])), 1)}


def test_metric_mentions_without_substrings_or_joins(spark):
    mentions = matching.metric_mentions(spark.createDataFrame(_QUESTIONS, "question_id int, question string"), spark.createDataFrame(_DICTIONARY, "metric string, alias string, position int"))
    got = list(map(tuple, mentions.collect()))
    assert len(got) == len(set(got)) and set(got) == _named(_DICTIONARY, _QUESTIONS)
    plan = mentions._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "substr" not in plan


def test_ambiguous_phrases_join_the_questions_once(spark):
    rules = {"ring": (("red", "blue"), ("size",)), "cash": (("bank",), ("profit",))}
    dictionary = [x for x in _DICTIONARY if x[0] != "ring"] + [("ring", "small ring", 0), (None, "ring", 0)]
    questions = [*_QUESTIONS, (9, "r ing"), (10, "ring red"), (11, "cash and ring"), (12, "净利润 cash"), (13, "rings")]
    asked = spark.createDataFrame(questions, "question_id int, question string")
    aliases = spark.createDataFrame(dictionary, "metric string, alias string, position int")
    mentions = spark.createDataFrame(sorted(_named(dictionary[:-1], questions), key=str), "question_id int, metric string, alias string, place int")
    out = matching.ambiguous_phrases(asked, mentions, aliases, rules)
    assert out._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    want = []
    for k, t in questions:
        q = "".join((t or "").split())
        met = {m for n, m, _, _ in _named(dictionary[:-1], questions) if n is not None and n == k}
        for phrase, (resolving, meant) in rules.items():
            covered = any(m in met and phrase in "".join((a or "").split()) and "".join((a or "").split()) in q for m, a, _ in dictionary)
            if phrase in q and not any(w in q for w in resolving) and not covered and not met & set(meant):
                want.append((k, phrase))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and want
