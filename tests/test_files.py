"""Sources, catalog, golden sets, bundles, crawl bookkeeping, streaming: over real files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.functions import urls
from quern.operators import bundle, catalog, chunking, embedding, lexical, web
from quern.plans.retriever import Corpus, Retriever
from quern.sources import corpus, golden, reader
from quern.streaming import ingest

PAGE = "---\ntitle: {t}\nproduct_area: Core\nlast_updated: 2024-05-01\n---\n# {t}\nBody of {t}\n## More\nneedle-{t} here\nlast line\n"


@pytest.fixture()
def mirror(tmp_path):
    for name in ("guide/a.md", "guide/sub/b c.md", "ref/x+y.md", "root.md"):
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(PAGE.format(t=path.stem).replace("\n", "\r\n").encode() + b"\xff")
    (tmp_path / "docs/guide/skip.txt").write_text("needle")
    return str(tmp_path / "docs")


def test_local_source(spark, mirror):
    rows = {r["path"]: r for r in corpus.LocalSource(spark, mirror).files().collect()}
    assert sorted(rows) == ["guide/a.md", "guide/sub/b c.md", "ref/x+y.md", "root.md"]
    assert (rows["guide/sub/b c.md"]["publication"], rows["guide/sub/b c.md"]["file"]) == ("guide", "sub/b c.md")
    assert (rows["root.md"]["publication"], rows["root.md"]["file"]) == ("root.md", "root.md")
    assert "\r" not in rows["root.md"]["text"] and rows["root.md"]["text"].endswith("�")
    assert corpus.LocalSource(spark, mirror).files(limit=2).count() == 2
    assert tuple(corpus.LocalSource(spark, mirror).release_info().first()) == ("local", "local", "local://docs", 4)


def test_a_mirror_that_was_written_reads_back(spark, tmp_path):
    rows = [("p", "a/b c.md", "x\ny"), ("p", "d+e.md", "é"), ("q", "z.md", "z")]
    files = spark.createDataFrame(rows, "publication string, file string, text string")
    for _ in range(2):  # written again, files are replaced
        assert corpus.write_mirror(files, f"file://{tmp_path}/m") == 3
    got = corpus.LocalSource(spark, f"file://{tmp_path}/m").files()
    assert sorted((r["publication"], r["file"], r["text"]) for r in got.collect()) == rows


def test_passages_are_found_through_the_index(spark):
    docs = [(1, "f1", "p", "one two three four five"), (2, "f2", "q", "xone two three fourx"), (3, "f3", "q", "three two one"), (4, "f4", "p", "a-b")]
    chunks = spark.createDataFrame(docs, "id long, file string, publication string, text string")
    passages = spark.createDataFrame([(1, "one two three four"), (2, "two three"), (3, "b"), (4, "nothing of the kind here")], "query_id long, passage string")
    got = golden.containing(passages, chunks, lexical.build_index(chunks, {"text": F.col("text")}))
    assert {r["query_id"]: (r["expected_files"], r["expected_publications"]) for r in got.collect()} == {1: (["f1", "f2"], ["p", "q"]), 2: (["f1", "f2"], ["p", "q"]), 3: (["f4"], ["p"])}


def test_crawl_source(spark, mirror, tmp_path):
    record = tmp_path / "record.json"
    record.write_text(json.dumps({"source_url": "https://x", "crawled_at": "2024-02-03T04:05", "crawler_sha": "abc"}, indent=1))
    assert corpus.CrawlSource(spark, mirror, str(record)).release() == ("https://x", "crawl-2024-02-03", "abc")
    assert corpus.CrawlSource(spark, mirror).release() == ("unknown", "crawl-unknown", "unknown")


def test_crawl_record(spark, mirror, tmp_path):
    pages = spark.createDataFrame([("a", "https://h/x"), ("a", "https://h/y"), ("b", "https://h/z")], "section string, url string")
    fetched = spark.createDataFrame([("https://h/y", "<main>body</main>"), ("https://h/z", None)], "url string, html string")
    stored = pages.where("url = 'https://h/x'").select(urls.mirror_path(F.col("url")).alias("path"))
    path = f"file://{tmp_path}/record.json"
    told = web.write_record(spark, path, "https://h", "2024-05-06T07:08:09", "f00", web.outcome(pages, stored, fetched))
    assert (told["sections"], told["skipped"], told["fetched"], told["errors"], told["bytes"]) == (2, 1, 1, 1, 4)
    assert corpus.CrawlSource(spark, mirror, path).release() == ("https://h", "crawl-2024-05-06", "f00")


def test_only_files_below_markdown_are_chunked(spark):
    rows = [("markdown/p/a.md", "x"), ("README.md", "y"), ("docs/markdown/b.md", "z"), ("markdown/c.md", None)]
    files = chunking.below_markdown(spark.createDataFrame(rows, "path string, text string"))
    assert sorted(map(tuple, files.select("publication", "file").collect())) == [("c.md", "c.md"), ("p", "a.md")]
    assert [r["file"] for r in chunking.chunk_table(files).collect()] == ["a.md"]


def test_git_source_and_factory(spark, tmp_path):
    (tmp_path / "co/markdown/p").mkdir(parents=True)
    (tmp_path / "co/markdown/p/f.md").write_text("x")
    s = corpus.create_source(spark, "git", str(tmp_path / "co"), repo_url="https://r")
    assert [r["path"] for r in s.files().collect()] == ["p/f.md"] and s.release()[1] == "main"
    with pytest.raises(FileNotFoundError):
        corpus.GitSource(spark, str(tmp_path / "none"))
    for bad in (("svn", "x"), ("local", None), ("git", str(tmp_path / "co"))):
        with pytest.raises(ValueError):
            corpus.create_source(spark, *bad)


def test_catalog(spark, mirror):
    c = Corpus(corpus.LocalSource(spark, mirror))
    assert [tuple(r) for r in c.list_publications().collect()] == [("guide", 2), ("ref", 1), ("root.md", 1)]
    assert [tuple(r) for r in c.list_files("guide").collect()] == [("a.md", "a", "Core", "2024-05-01"), ("sub/b c.md", "b c", "Core", "2024-05-01")]
    got = c.read_file("guide", "a.md", max_chars=5).first()
    assert got["truncated"] and len(got["content"]) == 5 and got["frontmatter"]["title"] == "a"
    hits = c.search("needle").collect()
    assert [(r["file"], r["line"]) for r in hits] == [("guide/a.md", 9), ("guide/sub/b c.md", 9), ("ref/x+y.md", 9), ("root.md/root.md", 9)]
    assert hits[0]["preview"] == "## More\nneedle-a here\nlast line"
    assert [r["file"] for r in c.search(r"needle-[ab]\b", regex=True, scope="guide").collect()] == ["guide/a.md", "guide/sub/b c.md"]
    assert c.search("(", regex=True).count() == 0 and c.search("(").count() == 0
    assert c.search("needle", max_results=1).count() == 1
    assert c.search("--max-count").count() == 0


@pytest.mark.parametrize("path", ["../x", "/etc", "a/../../b", ""])
def test_traversal_is_refused(spark, mirror, path):
    c = Corpus(corpus.LocalSource(spark, mirror))
    with pytest.raises(ValueError):
        c.read_file(path, "a.md")
    with pytest.raises(ValueError):
        c.read_file("guide", path)
    if path:
        with pytest.raises(ValueError):
            c.search("x", scope=path)


def test_missing_files(spark, mirror):
    c = Corpus(corpus.LocalSource(spark, mirror))
    for call in (lambda: c.list_files("none"), lambda: c.read_file("guide", "none.md"), lambda: c.search("x", scope="none")):
        with pytest.raises(FileNotFoundError):
            call()


def test_data_source(spark, mirror, tmp_path):
    reader.register(spark)
    plain = corpus.LocalSource(spark, mirror).files().select("path", "publication", "file", "text")
    rows = spark.read.format("quern_markdown").load(mirror)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain.collect()))
    assert [r["path"] for r in rows.where("publication = 'ref'").collect()] == ["ref/x+y.md"] and rows.where("publication = 'root.md'").count() == 1 and rows.where("publication = '../docs'").count() == 0
    one = reader.MarkdownReader(mirror)
    list(one.pushFilters([reader.EqualTo(("publication",), "guide")]))
    assert [p.paths for p in one.partitions()] == [["guide/a.md", "guide/sub/b c.md"]]  # no other folder is listed
    many = [(f"f{i}", reader.BYTES_A_TASK // 3, 0) for i in range(7)]
    assert [len(p.paths) for p in reader.dealt(many)] == [3, 3, 1] and reader.dealt([]) == []


def test_data_source_as_a_stream(spark, mirror, tmp_path):
    reader.register(spark)

    def run():
        q = spark.readStream.format("quern_markdown").load(mirror).select("path").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(90)

    run()
    (Path(mirror) / "guide/late.md").write_text("x")
    run()
    assert sorted(r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["guide/a.md", "guide/late.md", "guide/sub/b c.md", "ref/x+y.md", "root.md"]


def test_files_that_fail_are_set_aside(spark, tmp_path):
    rows = [("p", "good.md", b"## A\ntext\n## B\nmore"), ("p", "bad.md", b"\xff\xfe"), ("p", "big.md", b"x" * 101), ("p", "gone.md", None), ("p", "blank.md", b" \r\n"), ("q", "heads.md", b"---\ntitle: t\n---\n## A\n## B\n")]
    files = spark.createDataFrame(rows, "publication string, file string, content binary")
    told = chunking.write_chunks(files, str(tmp_path / "c"), 100)
    assert told == {"chunks": 2, "files": 1, "read": 1, "size": 1, "decode": 1, "parse": 1, "chunk": 1}
    chunks, aside = chunking.read_chunks(spark, str(tmp_path / "c"))
    plain = chunking.chunks(spark.createDataFrame([("p", "good.md", rows[0][2].decode())], "publication string, file string, text string"))
    assert sorted(map(tuple, chunks.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert {r["file"]: (r["stage"], r["reason"]) for r in aside.collect()} == {"bad.md": ("decode", "not UTF-8"), "big.md": ("size", "101 bytes, more than 100"), "gone.md": ("read", "no content"), "blank.md": ("parse", "nothing but white space"), "heads.md": ("chunk", "no section with text")}


def test_counters_of_a_crawl_in_the_pass_that_writes(spark, tmp_path):
    links = spark.createDataFrame([("s", "https://h/a/1"), ("s", "https://h/a/2"), ("s", "https://h/a/3")], "section string, url string")
    stored = spark.createDataFrame([("markdown/a/1",)], "path string")
    fetched = spark.createDataFrame([("https://h/a/2", "<p>é</p>"), ("https://h/a/3", None)], "url string, html string")
    assert web.store_fetched(links, stored, fetched, str(tmp_path / "f")) == {"skipped": 1, "fetched": 1, "errors": 1, "bytes": 2}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "f")).collect()] == [("s", "markdown/a/2", "é")]


def test_golden(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"query": "q1", "expected_files": ["a"], "expected_publications": ["p"]}\n\n{"query": "q2"}\n')
    rows = golden.read_golden(spark, str(path)).orderBy("query").collect()
    assert [tuple(r) for r in rows] == [("q1", ["a"], ["p"]), ("q2", [], [])]
    path.write_text('{"query": "q1"}\nnot json\n')
    assert [r[0] for r in golden.existing_queries(spark, str(path)).collect()] == ["q1"]
    topics = spark.createDataFrame([(0, "q1", ["p"], ["a"]), (1, "q3", ["p"], ["b", "missing", "a"]), (2, "q3", ["z"], ["a"]), (3, "q4", ["p"], ["missing"])], "place int, query string, publications array<string>, files array<string>")
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    made = golden.build_golden(topics, files, golden.existing_queries(spark, str(path)))
    assert [tuple(r) for r in made.collect()] == [("q3", ["b", "a"], ["p"])]
    golden.write_golden(made, str(tmp_path / "out"))
    assert golden.read_golden(spark, str(tmp_path / "out")).count() == 1


def test_bundle_round_trip(spark, mirror, tmp_path):
    chunks = chunking.chunk_table(corpus.LocalSource(spark, mirror).files())
    index = lexical.build_index(chunks, {"text": F.col("text"), "file_path": lexical.file_path_field(F.col("file"))}, lexical.FIELD_WEIGHTS)
    vectors = embedding.store_precision(embedding.embed(chunks.select("id", "text"), lambda: embedding.hashing_model(16), 16)).select("id", "embedding", "norm")
    out = str(tmp_path / "bundle")
    manifest = bundle.write(out, chunks, index, vectors, {"repo": "r"})
    assert manifest["chunk_count"] == chunks.count() and manifest["embedding_dim"] == 16
    again = bundle.open_bundle(spark, out)
    assert again.chunks.count() == chunks.count() and "norm" in again.chunks.columns and again.index is not None
    assert {r["part"]: r["present"] and r["digest_ok"] and r["rows_ok"] for r in bundle.validate(spark, out).collect()} == {p: p != "embeddings/float32" for p in bundle.PARTS}
    asked = Retriever.open(spark, out, embedding.hashing_model(16), expected="r")
    for mode in ("vector", "keyword", "hybrid"):
        assert asked.search_docs("needle", mode=mode, min_score=-1.0).count() == 5
    assert asked.get_bundle_info()["source_repo"] == "r"
    asked.close()
    single = embedding.store_precision(embedding.embed(chunks.select("id", "text"), lambda: embedding.hashing_model(16), 16), "float32").select("id", "embedding", "norm")
    bundle.write(f"{out}-single", chunks, index, single, precision="float32")
    assert bundle.load_embeddings(spark, f"{out}-single").count() == chunks.count() and "norm" in bundle.open_bundle(spark, f"{out}-single").chunks.columns
    bundle.write(f"{out}-none", chunks, index)
    with pytest.raises(FileNotFoundError):
        bundle.load_embeddings(spark, f"{out}-none")
    with pytest.raises(ValueError):
        bundle.write(f"{out}-bad", chunks, index, single, precision="float8")
    chunks.limit(1).write.mode("overwrite").parquet(f"{out}/chunks")
    assert not bundle.validate(spark, out).where("part = 'chunks'").first()["digest_ok"]
    with pytest.raises(FileNotFoundError):
        bundle.open_bundle(spark, str(tmp_path / "nothing"))
    assert bundle.file_digests(spark, out).where("length(sha256) = 64").count() > 0


def test_urls(spark):
    index = "# T\n- [A](guide/a.md): x\n  - [B](/en/b.md)\n- [C](https://o.org/c.md)\n- [D](d.html)\ntext [E](e.md)\n- [F](../f.md)\n"
    df = spark.createDataFrame([("s", "https://h.org/en/docs/llms.txt", index)], "section string, base_url string, content string")
    assert [r["url"] for r in web.index_links(df).orderBy("place").collect()] == ["https://h.org/en/docs/guide/a.md", "https://h.org/en/b.md", "https://o.org/c.md", "https://h.org/en/f.md"]
    assert web.index_links(df, 2).count() == 2
    cases = {"https://h/en/guide/x/y.md?a#b": "markdown/guide/x/y.md", "https://h/one.md": "markdown/general/one.md", "https://h": "markdown/general/", "https://h/a/b": "markdown/a/b"}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.mirror_path(F.col("u")).alias("p")).collect()
    assert {r["u"]: r["p"] for r in rows} == cases


def test_main_text(spark):
    html = "<html><body><nav>N</nav><script>var a='</p>';</script><main><h1>T &amp; u</h1><p>one <b>two</b></p></main><footer>F</footer></body></html>"
    df = spark.createDataFrame([(html,), ("<body> x <article>in</article></body>",), ("plain &lt;",), (None,)], "h string")
    assert [r[0] for r in df.select(urls.main_text(F.col("h"))).collect()] == ["T & u\none\ntwo", "in", "plain <", None]


def test_crawl_outcome(spark):
    links = spark.createDataFrame([("s", "https://h/a/1"), ("s", "https://h/a/2"), ("s", "https://h/a/3")], "section string, url string")
    stored = spark.createDataFrame([("markdown/a/1",)], "path string")
    fetched = spark.createDataFrame([("https://h/a/2", "<p>é</p>"), ("https://h/a/3", None)], "url string, html string")
    assert [r["url"] for r in web.to_fetch(links, stored).orderBy("url").collect()] == ["https://h/a/2", "https://h/a/3"]
    assert tuple(web.outcome(links, stored, fetched).first()) == ("s", 1, 1, 1, 2)


def test_stream(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "p").mkdir(parents=True)
    (root / "p/a.md").write_text("## H\nalpha beta alpha\n")

    def run():
        ingest.ingest(ingest.markdown_stream(spark, str(root)), out, str(tmp_path / "cp")).awaitTermination(60)

    run()
    (root / "p/b.md").write_text("beta")
    run()
    run()
    chunks = spark.read.parquet(f"{out}/chunks")
    assert sorted(r["file"] for r in chunks.collect()) == ["a.md", "b.md"]
    postings = spark.read.parquet(f"{out}/postings")
    assert {(r["term"], r["tf"]) for r in postings.where("id = 'p/a.md#0'").collect()} == {("overview", 1), ("h", 1), ("alpha", 2), ("beta", 1)} - {("overview", 1)}
    assert Path(tmp_path / "cp").exists()


def test_catalog_handles_nulls(spark):
    df = spark.createDataFrame([("p", "f.md", None), ("p", "g.md", "x")], "publication string, file string, text string")
    assert [r["file"] for r in catalog.search_text(df, "x").collect()] == ["p/g.md"]
    assert catalog.list_files(df, "p").count() == 2


def test_snapshot_and_restore(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x y")], "id string, text string")
    folder, store = str(tmp_path / "b"), str(tmp_path / "store")
    manifest = bundle.write(folder, chunks, lexical.build_index(chunks, {"text": F.col("text")}), None, {"repo": "r"})
    saved = bundle.snapshot(spark, folder, store)
    spark.createDataFrame([("z", "q")], "id string, text string").write.mode("overwrite").parquet(f"{folder}/chunks")
    bundle.restore(spark, saved, folder)
    ids = lambda: [r["id"] for r in bundle.open_bundle(spark, folder).chunks.collect()]
    assert ids() == ["a"] and not bundle.validate(spark, folder).where("present AND NOT (rows_ok AND digest_ok)").count()
    again = bundle.snapshot(spark, folder, str(tmp_path / "store2"))  # of what the pointer names
    assert bundle.file_digests(spark, f"{again}/chunks").count() == bundle.file_digests(spark, f"{saved}/chunks").count()
    with pytest.raises(ValueError):
        bundle.snapshot(spark, folder, f"{folder}/inside")
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError):
        bundle.restore(spark, saved, str(tmp_path / "other"))
    bundle.restore(spark, saved, str(tmp_path / "new"))
    assert [r["id"] for r in bundle.open_bundle(spark, str(tmp_path / "new")).chunks.collect()] == ["a"]
    assert bundle.check_source(manifest, "r")
    with pytest.warns(UserWarning):
        assert not bundle.check_source(manifest, "other")


def test_a_restore_that_fails_leaves_the_bundle(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([("a", "x y")], "id string, text string")
    folder = str(tmp_path / "b")
    bundle.write(folder, chunks, lexical.build_index(chunks, {"text": F.col("text")}))
    saved = bundle.snapshot(spark, folder, str(tmp_path / "store"))
    spark.createDataFrame([("b", "q")], "id string, text string").write.mode("overwrite").parquet(f"{folder}/chunks")
    ids = lambda: [r["id"] for r in bundle.open_bundle(spark, folder).chunks.collect()]
    # killed when all files are there but the pointer has not moved
    with monkeypatch.context() as m:
        m.setattr(bundle, "_point", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            bundle.restore(spark, saved, folder)
    assert ids() == ["b"] and len(bundle.versions(spark, folder, remove=True)) == 1 and bundle.versions(spark, folder) == []
    # a file of the snapshot that is damaged, one that is gone, and a snapshot that was never finished
    part = next(Path(f"{saved}/chunks").glob("*.parquet"))
    whole = part.read_bytes()
    for break_it in (lambda: part.write_bytes(whole[:-1] + b"?"), part.unlink, Path(f"{saved}/FILES.json").unlink):
        break_it()
        with pytest.raises(ValueError):
            bundle.restore(spark, saved, folder)
        assert ids() == ["b"] and bundle.versions(spark, folder) == []


def test_sql_functions(spark):
    from quern.functions import sql

    sql.register(spark)
    row = spark.sql("SELECT quern_tokens('A-b'), quern_words(' x X y'), quern_hits('xyz', array('x', 'q')), quern_has_fence('a\n```'), quern_dot(array(1D, 2D), array(3D, 4D))").first()
    assert tuple(row) == (["a", "b"], ["x", "y"], 1, True, 11.0)


def test_term_counts_of_a_stream(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.md").write_text("x y x")
    (tmp_path / "p/b.md").write_text("y")
    counts = ingest.term_counts(ingest.markdown_stream(spark, str(tmp_path)))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("quern_terms").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["term"], r["df"]) for r in spark.table("quern_terms").collect()} == {("x", 1), ("y", 2)}
