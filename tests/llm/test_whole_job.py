"""Cases in which operators once did less than the whole job."""

from pyspark.sql import functions as F

import corpus_pipeline
from bankflow.llm import html_extract, license_scan, mixing, queries


def test_a_stray_cell_does_not_shrink_the_others(spark):
    body = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"{body} {i}", "en" if i % 4 else "de", "a" if i % 3 else "b") for i in range(600)]
    rows.append((900, "stray", None, "new"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed(df, queries.document_dimensions()).collect()
    assert sum(r["sampled"] for r in got) > 0.9 * len(rows)
    there = sum(r["n_tokens"] for r in got)
    assert abs(sum(r["probability"] * r["n_tokens"] for r in got) - there) < 1e-3 * there
    assert abs(sum(r["copies"] * r["n_tokens"] for r in got) - there) < 0.05 * there
    assert all(r["copies"] in (int(r["probability"]), int(r["probability"]) + 1) for r in got)
    stray = next(r for r in got if r["doc"]["doc_id"] == 900)
    assert stray["probability"] > 2 and stray["copies"] >= 2
    half = mixing.mixed(df, queries.document_dimensions(), mix=mixing.Mix(token_budget=there / 2))
    assert abs(half.agg(F.sum(F.col("probability") * F.col("n_tokens"))).first()[0] - there / 2) < 1e-3 * there
    kept = corpus_pipeline.keep_mixed(spark, df, "")
    assert kept.columns == df.columns and kept.count() == sum(r["copies"] for r in got)
    held = corpus_pipeline.write_tokens(spark, kept, "").collect()
    assert {r["doc_id"]: r["copies"] for r in held} == {r["doc"]["doc_id"]: r["copies"] for r in got if r["sampled"]}


def test_copies_of_short_lines_go(spark, tmp_path):
    url = "https://example.org/" + "x" * 300
    rows = [(1, f"这是一个没有空格的句子\n{url}\n\nx y\na b c"), (2, f"{url}\n这是一个没有空格的句子\n\nx z\na b d"), (3, "x  y\n \nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(2, 0, 1, 1, 0), (2, 1, 1, 0, 0), (2, 4, 1, 4, 1), (3, 0, 1, 3, 0)}


def extracted(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = html_extract.extract_main_text(df).select("doc.page_id", "text").collect()
    return [r["text"] for r in sorted(got)]


WORDS = "The first sentence stands here, as it should. A second one follows it, and it is longer than the first."


def test_heads_and_drawings_without_an_end_lose_no_text(spark):
    article = f"<article><h1>Title</h1><p>{WORDS}</p><p>{WORDS}</p></article>"
    body = f"<nav><ul><li><a href=/>Home</a></ul></nav>{article}<footer>me</footer>"
    want = f"Title\n{WORDS}\n{WORDS}"
    drawing = '<svg viewBox="0 0 1 1"/>'
    pages = [
        f"<html><head><title>T</title><script>'<p>no</p>'</script><body>{body}</body></html>",
        f"<head><meta charset=utf-8><title>About <div></title><style>p > a</style>{body}",
        f"<html><head><title>T</title></head><body>{drawing}{body}</body></html>",
        f"<html><head></head><body>{body.replace('<h1>', '<h1>' + drawing)}<svg><path/></svg></body></html>",
        f"<body><iframe src=x /><noscript>no{' ' * 9}</noscript>{body}<svg><text>no</text></svg><template>",
        f"<body>{body}<script>open '<p>{WORDS}</p>'",
    ]
    assert extracted(spark, pages) == [want] * len(pages)
    assert extracted(spark, [f"<head><title>T</title>{WORDS}"]) == [WORDS]


def test_text_bare_in_the_body_is_judged(spark):
    article = "<br><br>".join([WORDS, WORDS + " <b>Bold.</b>", WORDS])
    want = " ".join([WORDS, WORDS, "Bold.", WORDS])
    links = "<a href=/>Home</a> | <a href=/a>About us</a> | <a href=/b>Contact</a>"
    pages = [
        f"<html><head></head><body>{article}<div class=footer>me</div></body></html>",
        f"<body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>{article}<footer>me</footer></body>",
        f"<body>{links}<div class='cookie notice'><p>We use cookies.</p></div>{article}<div class=ad>Buy now.</div>",
    ]
    assert extracted(spark, pages) == [want] * len(pages)
    assert extracted(spark, [f"{WORDS}<br>x"]) == [f"{WORDS} x"]


def test_common_licences_keep_their_labels(spark):
    texts = ["MIT License", "under CC BY-NC", "Mozilla Public License", "see the Apache License", "no words of that kind"]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(50)], "doc_id long, text string")
    got = license_scan.license_scan(df).select("doc.doc_id", "labels").collect()
    want = ["mit", "cc-by,cc-by-nc", "mpl-2.0", "apache", ""]
    # the base phrase 'cc by' stands in 'CC BY-NC' too
    assert {r["doc_id"]: r["labels"] for r in got} == {i: want[i % 5] for i in range(50)}


def test_different_texts_under_one_id_all_stay(spark, tmp_path):
    body = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, body("a")), (1, body("b")), (1, body("b")), (2, body("b")), (3, body("c")), (1, None), (None, body("d"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, body("a")), (1, body("b")), (3, body("c")), (1, ""), (-1, body("d"))])
    kept = corpus_pipeline.keep_one_of_each(spark, df, "")
    got = sorted((-1 if r[0] is None else r[0], r[1] or "") for r in kept.collect())
    # of (1, b) and (2, b) one stays
    assert sorted((1, t) if (d, t) == (2, body("b")) else (d, t) for d, t in got) == want
    bench = spark.createDataFrame([(1, body("b"))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.keep_uncontaminated(spark, df, str(tmp_path)).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1] or "") for r in clean) == sorted(set(want) - {(1, body("b"))})
