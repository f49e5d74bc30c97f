from tidewright.llm.page_differencing import extract_pages


def page(body, wrap="<body>{}"):
    return wrap.format(f"<p>Site name</p><p>{body}</p><p>All rights reserved</p>")


def extracted(spark, rows, parts):
    return {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}


def test_frame_lines_inside_main_are_deleted(spark):
    rows = [(i, f"http://h/a/{i}", page(f"story {i}", "<main>{}</main>")) for i in range(4)]
    assert extracted(spark, rows, 2) == {i: f"story {i}" for i in range(4)}
    quotes = [(i, f"http://h/a/{i}", f"<article><p>quoted</p><p>story {i}</p></article>") for i in range(2)]
    assert extracted(spark, quotes, 1) == {i: f"quoted\n\nstory {i}" for i in range(2)}
    copies = [(i, f"http://h/a/{i}", f"<p>menu {i}</p><article><p>one story</p></article>") for i in range(2)]
    assert extracted(spark, copies, 1) == {0: "one story", 1: "one story"}


def test_every_page_meets_the_nearest_different_path(spark):
    """In the middle of a run of equal paths, and at the edges of ranges."""
    rows = [(i, f"http://h/a/{i // 7}", page(f"story {i}")) for i in range(70)] + [(100, "http://alone/x", page("kept"))]
    got = extracted(spark, rows, 5)
    assert all(got[i] == f"story {i}" for i in range(70)) and got[100].startswith("Site name")
