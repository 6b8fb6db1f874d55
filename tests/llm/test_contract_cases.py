"""Cases of the contracts of the archive and main-text queries that once failed."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.llm import html_tree, queries

LONG = "Article text, long enough to count. " * 10


def test_archive_query_with_null_ids(spark, tmp_path):
    html = "<p>" + "x" * 1200 + "</p>"
    rows = [(None, "u", html), (5, None, html), (7, "w", html), (7, "w", html), (8, "v", None), (None, None, None), (-3, "n", "short")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit(1)).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in queries.op3_warc(spark, str(tmp_path)).collect())
    size = len(html)
    assert got == [
        (False, 0, 0, "response", None), (False, 0, size, "revisit", 7), (True, -3, 5, "response", None), (True, 5, size, "revisit", 7),
        (True, 7, size, "response", None), (True, 7, size, "response", None), (True, 8, 0, "response", None),
    ]


def test_generated_names_of_headings_and_sections_drop_nothing():
    page = (
        f"<body><article><p>{LONG}</p><h2 id='sharing-data'>Sharing data</h2><section id='related-work-2'><h2 id='related'>Related</h2><p>Prior work.</p></section>"
        "<div class='comments'><p>nice</p></div><div class='ad-slot-2'>buy</div><div id='relatedPosts'>more</div></article></body>"
    )
    assert html_tree.main_text(page).split("\n") == [LONG.strip(), "Sharing data", "Related", "Prior work."]
    assert html_tree.main_text(f"<body><p>{LONG}</p><p class='notice-period'>One month.</p><p class='cookie-notice'>We store.</p></body>").split("\n") == [LONG.strip(), "One month."]


def test_forms():
    page = f"<body><form><input name=state><div><p>{LONG}</p><select><option>a</select><button>Go</button></div></form><footer>f</footer></body>"
    assert html_tree.main_text(page) == LONG.strip()
    assert html_tree.main_text(f"<body><p>{LONG}</p><form><p>Subscribe to the letter.</p></form></body>") == LONG.strip()
    assert html_tree.main_text("<body><form><input></form></body>") == ""


def test_repeated_pages_give_repeated_rows(spark):
    rows = [(1, "u", f"<p>{LONG}</p>")] * 3 + [(None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_tree.extract(df).collect())
    assert got == [(0, "", 0)] + [(1, LONG.strip(), len(LONG.strip()))] * 3 + [(2, "", 0)]
