"""What the plans of queries must not hold: steps whose cost a row, or whose shuffle, was too large."""

import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["score_explanation", "seo_rubric_labels"])
def test_factors_are_ranked_in_compiled_code(spark, name):
    text = plan(entry_module.queries()[name](spark, FOLDER))
    # functions called for each element are not compiled; what is left of them drops nulls from short lists
    assert "sort_array(" in text and "array_sort(" not in text and "transform(" not in text and "aggregate(" not in text


def test_views_are_dealt_before_they_are_measured(spark):
    from rankloom.operators import evaluation
    from rankloom.plans import evaluation_queries as eq
    from rankloom.sources.views import load_dealt, load_view

    rows = load_dealt(spark, FOLDER, "v_rows", "query")
    assert sorted(map(tuple, rows.select("query", "url", "semantic_similarity").collect())) == sorted(
        map(tuple, load_view(spark, FOLDER, "v_rows").select("query", "url", "semantic_similarity").collect())
    )
    # a query that is too large for a task is not dealt
    assert load_dealt(spark, FOLDER, "v_rows", "query", own=1) is None
    predictions, dealt = eq.dealt_predictions(spark, FOLDER)
    metrics = evaluation.model_metrics(predictions, dealt)
    # what is shuffled on the way to the metrics of a query are columns of the tables, neither URLs nor predictions
    steps = metrics._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(")
    assert any("concat(https://s" in s for s in steps) and "concat(https://s" not in steps[-1]
    assert sorted(map(tuple, metrics.collect())) == sorted(map(tuple, evaluation.model_metrics(eq.predictions(spark, FOLDER)).collect()))
    errors = evaluation.regression_metrics(predictions).collect()
    assert {r["model"]: tuple(r) for r in errors} == {r["model"]: tuple(r) for r in metrics.select("model", "rows", "rmse", "mae").collect()}


@pytest.mark.parametrize("name", ["release_decision", "candidate_compare"])
def test_models_are_measured_once(spark, name):
    # what is left reads the written table of models, not the rows again for each model
    assert "row_number" not in plan(entry_module.queries()[name](spark, FOLDER))


def test_audits_are_dealt_once_and_not_again(spark):
    steps = entry_module.queries()["recommendation_rules"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cast(l_partkey" in steps and "hashpartitioning(audit_id" not in steps


def test_hard_negatives_parse_pages_once(spark):
    # every page is parsed before the plan of the result, which reads the parsed ones
    assert "ArrowEvalPython" not in plan(entry_module.queries()["hard_negatives"](spark, FOLDER))


def test_documents_of_a_batch_are_parsed_in_slices(spark):
    from rankloom.operators.extraction import PARSED_AT_ONCE, document_of, read_document

    pages = [(i, None if i % 50 == 3 else f"<title> T{i} &amp; x\x1f </title><p>a\n b<a href='/{i}'>l</a>") for i in range(3 * PARSED_AT_ONCE + 5)]
    rows = spark.createDataFrame(pages, "i int, html string").coalesce(1).select("i", document_of("html").alias("d")).collect()
    assert [(r.i, r.d.asDict(recursive=True)) for r in sorted(rows)] == [(i, read_document(h)) for i, h in pages]
    assert max(len(h or "") for _, h in pages) > 0 and read_document(pages[0][1])["title"] == "T0 & x"


def test_page_features_do_no_work_of_a_row_for_each_token(spark):
    text = plan(entry_module.queries()["feature_matrix_pages"](spark, FOLDER))
    # a list named once is built anew in the lambda; long texts are searched by bytes, not by a regex of all words
    assert "array_contains(array_distinct(" not in text and "доставка|shipping" not in text


def test_cheaper_searches_find_the_same(spark):
    from pyspark.sql import functions as F

    from rankloom.functions import text as tx
    from rankloom.functions.urls import literal_alternation
    from rankloom.operators import page_features as pf

    texts = ["", " a  b\n", "a\n b \t c", "цены Москвы\nкрасивыми столами и ёлками", "р. 5", "100 руб.", "от 12 000 ₽", "RATING 4.5", "рейтинг: 4,5 из 5", "ul. ул.x", "rating x", "price 5 usd"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = rf"(?<={tx.WORD}{{4}})(?:{'|'.join(tx.TOKEN_SUFFIXES)})(?!{tx.WORD})"
    low = F.lower("t")
    pairs = {
        "scan": (tx.scan_text(F.col("t")), F.lower(F.trim(F.regexp_replace("t", r"(?U)\s+", " ")))),
        "stems": (tx.stemmed_tokens(F.col("t")), F.regexp_extract_all(F.regexp_replace(F.replace(low, F.lit("ё"), F.lit("е")), plain, ""), F.lit(f"({tx.WORD}+)"), F.lit(1))),
        "currency": (tx.contains_any(low, pf.CURRENCY_MARKS), low.rlike(pf.CURRENCY_PATTERN)),
        "price": (tx.contains_any(low, pf.CURRENCY_MARKS) & low.rlike(pf.PRICE_PATTERN), low.rlike(pf.PRICE_PATTERN)),
        "rating": (tx.contains_any(low, pf.RATING_WORDS) & low.rlike(pf.RATING_PATTERN), low.rlike(pf.RATING_PATTERN)),
        **{n: (tx.contains_any(low, w), low.rlike(literal_alternation(w))) for n, w in pf.KEYWORDS.items()},
    }
    got = rows.select(*[F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in pairs.items()]).collect()
    assert all(r[n].a == r[n].b for r in got for n in pairs) and any(r["rating"].a for r in got) and any(r["price"].a for r in got)
