from pyspark.sql import functions as F

from tessera.operators import html
from tessera.plans import pages_and_files
from tessera.plans.registry import Tables
from tessera.sources import files
from tessera.streaming.arrivals import process_new

PAGE = '<html><head><title>t</title><style>x</style></head><body><nav>menu</nav><h1>A <b>title</b></h1><article class="content"><p>One &amp; two<br>three</p><p>four</p></article><a href="/a.pdf">x</a><a href="/a.pdf">y</a><footer>end</footer></body></html>'


def test_html_text():
    assert html.blocks_of("<p>a<br/>b</p><div>c</div>") == "a\n\nbc"
    assert html.clean_of(PAGE) == "t\nA\ntitle\nOne & two\nthree\nfour\nx\ny"
    assert html.main_of(PAGE, ("article",)) == html.main_of(PAGE, ("main", ".content")) == "One & two\n\nthree\n\nfour"
    assert html.main_of("no body at all", ("article",)) == ""


def test_html_references_closed_or_not():
    page = "<body><p>a &amp;b &amp<b>c</b> &lt d &#38;e &#38 f &nosuch; \ue000</p><script>x &amp y && z</script></body>"
    assert html.blocks_of(page) == "a &b &c < d &e & f &nosuch; \ue000x &amp y && z"
    assert html.blocks_of(page, closed=True) == "a &b &ampc &lt d &e &#38 f &nosuch; \ue000x &amp y && z"
    assert html.main_of(page, (), closed=True) == "a &b &ampc &lt d &e &#38 f &nosuch; \ue000"
    assert html.clean_of(page, closed=True).startswith("a &b &amp\nc\n&lt d")


def test_html_columns(spark):
    d = spark.createDataFrame([(PAGE,), (None,), ("",)], "h string")
    rows = d.select(html.title(F.col("h"), F.lit("slug")).alias("t"), html.hrefs(F.col("h"), "pdf$").alias("l"), html.text_clean("h").alias("c")).collect()
    assert rows[0].t == "A title" and rows[0].l == ["/a.pdf"]
    assert rows[1].t == "slug" and rows[1].c is None and rows[2].c == ""


def test_files(spark, tmp_path):
    for name in ("a/x.txt", "a/_y.txt", "_b/z.txt", "c/_temp_downloads/w.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text")
    got = [(r.source, r.name, r.kind, r.doc_id) for r in files.corpus(spark, str(tmp_path), "*.txt").collect()]
    assert [g[:3] for g in got] == [("a", "x.txt", "txt")] and len(got[0][3]) == 12
    assert files.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/a"]) == f"{tmp_path}/a"


def test_a_walk_of_the_service_reads_each_file_once(spark):
    service = pages_and_files._service(Tables(spark, "/root/testdata/sf0.001"), most=150)
    opened, table = [], service.table
    service.table = lambda i: opened.append(i) or table(i)
    total, page, walked = service.first[-1], 0, []
    while rows := service.rows(page * 40, 40):
        walked += [r["event_id"] for r in rows]
        page += 1
    assert len(service.files) > 2 and len(walked) == total and walked == sorted(set(walked))
    # A file is left for the next one only, so it is read once; what is behind or far ahead is not read at all.
    assert opened == sorted(opened) and set(opened) == set(range(len(service.files)))
    assert [r["event_id"] for r in service.after(walked[99], walked[160], 500)] == walked[100:160]
    opened.clear()
    assert [r["event_id"] for r in service.after(walked[9], walked[-1], 5)] == walked[10:15] and len(set(opened)) == 1


def test_new_files_once(spark, tmp_path):
    d = spark.range(5)
    d.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        process_new(spark, f"{tmp_path}/in", "id long", lambda x: x.where("id > 1"), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
