"""Searches over a small tree with traps, and the operators around them."""

import json
import socket

import pytest
from pyspark.sql import functions as F

from treesift import server
from treesift.api import Engine
from treesift.cli import main
from treesift.functions import highlight
from treesift.functions.text import CATEGORIES
from treesift.operators import diff, history, tree
from treesift.operators.ingest import ingest, select_listing
from treesift.operators.search import refine, search
from treesift.plans.compiler import narrows
from treesift.plans.parser import parse
from treesift.plans.query import SearchOptions
from treesift.sources import export, listing, snapshot
from treesift.streaming import live

NOW = 1_706_659_200.0
OLD = NOW - 200 * 86_400
FILES = [
    ("report.txt", 200, NOW), ("reporting_x.txt", 4, None), ("star*name.txt", 4, None), ("pkgtest.bundle/inner.bin", 3, None), ("dupA/twin_name.txt", 6, None),
    ("dupB/twin_name.txt", 7, None), ("Report.PNG", 300, OLD), ("notes.md", 50, None), ("README.md", 80, None), ("app.swift", 120, None), ("AppModel.swift", 400, None),
    ("data/data.json", 1 << 20, None), ("data/big.bin", 5 << 20, OLD), ("data/tiny.txt", 10, None), ("intl/한글파일.txt", 30, None), ("intl/가.txt", 12, None),
    ("intl/café.md", 30, None), ("intl/CAFÉ.txt", 30, None), ("src/a/b/c/d/leaf.txt", 5, NOW), ("leaf.txt", 400, NOW), ("scatter/a_p_p.txt", 8, None),
    (".hidden/.secret.txt", 5, None), ("zdir/marker_apple.txt", 8, None), ("adir/marker_zebra.txt", 8, None), ("thumbs.jpg/picture.jpg", 5, None),
    ("kind/manual.pdf", 12, None), ("kind/SHOUT.PDF", 12, None), ("kind/song.mp3", 12, None), ("kind/installer.dmg", 12, None), ("kind/notes.noext", 12, None), ("odd.", 1, None), ("my report 2.txt", 9, None),
]


def rows_of(files):
    out = [(f"/{p}", p.rsplit("/", 1)[-1], n, int((t or NOW - 3 * 86_400) * 1e9), 5, 1, 0) for p, n, t in files]
    return [*out, ("/emptydir", "emptydir", 0, 0, 0, 2, 0), ("/alias", "alias", 3, 0, 0, 5, 0x8000)]


SCHEMA = "path string, name string, size long, mtime_ns long, crtime_ns long, obj_type int, flags long"


@pytest.fixture(scope="module")
def entries(spark):
    return ingest(spark.createDataFrame(rows_of(FILES), SCHEMA)).cache()


def find(entries, query, **more):
    return [r.path for r in search(entries, query, now=NOW, **more).ranked().orderBy("rank").collect()]


@pytest.mark.parametrize(
    "query, want",
    [
        ("report", ["/my report 2.txt", "/Report.PNG", "/report.txt", "/reporting_x.txt"]),
        ("report ext:txt size:>100", ["/report.txt"]),
        ("ww: report", ["/my report 2.txt", "/Report.PNG", "/report.txt"]),
        ("case:on Report", ["/Report.PNG"]),
        ("report -txt", ["/Report.PNG"]),
        ("notes|readme ext:md", ["/notes.md", "/README.md"]),
        ("report*", ["/Report.PNG", "/report.txt", "/reporting_x.txt"]),
        ('"star*"', ["/star*name.txt"]),
        ("?.txt", ["/intl/가.txt"]),
        ("cafe", ["/intl/CAFÉ.txt", "/intl/café.md"]),
        ("café ext:txt", ["/intl/CAFÉ.txt"]),
        ("한글", ["/intl/한글파일.txt"]),
        ("path:data/t", ["/data/tiny.txt"]),
        ("folder: path:src/a/b/c", ["/src/a/b/c", "/src/a/b/c/d"]),
        ("dupe:", ["/leaf.txt", "/src/a/b/c/d/leaf.txt", "/dupA/twin_name.txt", "/dupB/twin_name.txt"]),
        ("empty:", ["/emptydir"]),
        ("file: bundle", ["/pkgtest.bundle"]),
        ("folder: thumbs", ["/thumbs.jpg"]),
        ("file: type:images", ["/thumbs.jpg/picture.jpg", "/Report.PNG"]),
        ("type:archives type:apps", ["/kind/installer.dmg"]),
        ("dm:today leaf", ["/leaf.txt", "/src/a/b/c/d/leaf.txt"]),
        ("dm:<2023-12-01 file:", ["/alias", "/data/big.bin", "/pkgtest.bundle", "/Report.PNG"]),
        ("size:>=1mb", ["/data/big.bin", "/data/data.json"]),
        ("len:4..6 ext:md", []),
        ("len:9 startwith:re", ["/README.md"]),
        ("endwith:.pdf -startwith:sh", ["/kind/manual.pdf"]),
        ("ext:.", ["/odd."]),
        ("ext:txt -ext:txt", []),
        ("nothing:here", []),
    ],
)
def test_searches(entries, query, want):
    assert find(entries, query) == want


@pytest.mark.parametrize("category", CATEGORIES)
def test_a_category_is_its_extensions(entries, category):
    assert find(entries, f"type:{category}") == find(entries, f"ext:{CATEGORIES[category].replace(' ', ',')}")


def test_modes(entries):
    assert find(entries, "leaf.txt", mode="wildcard") == ["/leaf.txt", "/src/a/b/c/d/leaf.txt"]
    assert find(entries, "leaf", mode="wildcard") == []
    assert find(entries, "leaf", mode="wildcard", options=SearchOptions(whole_name_wildcards=False)) == ["/leaf.txt", "/src/a/b/c/d/leaf.txt"]
    assert find(entries, r"^re.*\.(txt|png)$", mode="regex") == ["/Report.PNG", "/report.txt", "/reporting_x.txt"]
    assert find(entries, "[", mode="regex") == [] and len(find(entries, " ", mode="regex")) == entries.count()
    assert find(entries, "app", mode="fuzzy", sort="relevance", ascending=False)[:4] == ["/app.swift", "/AppModel.swift", "/scatter/a_p_p.txt", "/zdir/marker_apple.txt"]


def test_orders(entries):
    assert find(entries, "marker", sort="path") == ["/adir/marker_zebra.txt", "/zdir/marker_apple.txt"]
    assert find(entries, "leaf", ascending=False) == ["/src/a/b/c/d/leaf.txt", "/leaf.txt"]
    assert find(entries, "data", sort="size", ascending=False)[0] == "/data"
    assert find(entries, "data", sort="size", ascending=False, options=SearchOptions(folder_sizes=False)) == ["/data/data.json", "/data"]
    assert find(entries, "a", options=SearchOptions(folders_first=True))[:2] == ["/src/a", "/adir"]
    assert find(entries, "leaf", sort="relevance", ascending=False) == ["/leaf.txt", "/src/a/b/c/d/leaf.txt"]
    everything = find(entries, "")
    assert find(entries, "", sort="relevance", ascending=False) == everything[::-1] and len(find(entries, "", limit=3)) == 3
    r = search(entries, "report", limit=2)
    assert r.total() == 4 and r.truncated()


def test_scopes_and_hidden(entries):
    assert find(entries, "", scope_root="/src/a/b/c/d") == ["/src/a/b/c/d", "/src/a/b/c/d/leaf.txt"]
    assert find(entries, "", scope_root="/leaf.txt") == ["/leaf.txt"] and find(entries, "", scope_root="/no") == []
    hidden = set(find(entries, "")) - set(find(entries, "", options=SearchOptions(hide_hidden=True)))
    assert hidden == {"/.hidden", "/.hidden/.secret.txt", "/alias"}


def test_run_history(spark, entries):
    ran = spark.createDataFrame([("/reporting_x.txt", 3, NOW), ("/Report.PNG", 10, NOW - 60 * 86_400), ("/gone", 9, NOW)], "path string, count long, last_run double")
    assert find(entries, "report", sort="runcount", ascending=False, history=ran) == ["/reporting_x.txt", "/Report.PNG", "/my report 2.txt", "/report.txt"]
    assert find(entries, "report", sort="runcount", history=ran)[:2] == ["/Report.PNG", "/reporting_x.txt"]
    more = history.record(ran, spark.createDataFrame([("/a", 5.0), ("/a", 7.0), ("/gone", 1.0)], "path string, at double"))
    assert {tuple(r) for r in more.collect()} == {("/reporting_x.txt", 3, NOW), ("/Report.PNG", 10, NOW - 60 * 86_400), ("/gone", 10, NOW), ("/a", 2, 7.0)}
    assert [r.path for r in history.prune(more, NOW, cap=2).collect()] == ["/gone", "/reporting_x.txt"]
    saved = spark.createDataFrame([("A", "x"), ("b", "y")], "name string, query string")
    assert {tuple(r) for r in history.upsert_saved(saved, spark.createDataFrame([("a", "z")], saved.schema)).collect()} == {("b", "y"), ("a", "z")}


def test_contents_and_tags(spark, entries):
    contents = spark.createDataFrame([("/report.txt", "Hello World"), ("/notes.md", "hello"), ("/data", "hello"), ("/leaf.txt", None)], "path string, content string")
    assert find(entries, "content:HELLO", contents=contents) == ["/notes.md", "/report.txt"]
    assert find(entries, "case:on content:Hello", contents=contents) == ["/report.txt"]
    r = search(entries, "content:hello", contents=contents, options=SearchOptions(content_budget=2))
    assert r.content_incomplete() and r.total() <= 2
    tags = spark.createDataFrame([("/report.txt", ["Red\n6", "Work"]), ("/notes.md", ["Blue\n4"])], "path string, tags array<string>")
    assert find(entries, "tag:red;blue", tags=tags) == ["/notes.md", "/report.txt"] and find(entries, "tag:red t:wor", tags=tags) == ["/report.txt"]
    with pytest.raises(ValueError):
        search(entries, "content:x")


def test_refine_gives_what_a_new_search_gives(entries):
    queries = ["re", "rep", "rep txt", "rep txt -x", "rep ext:txt", "report|note", "r*", "rep size:>5", "ww: report", "file: rep", "-a", "-app"]
    for old in queries:
        first = search(entries, old, now=NOW)
        for new in queries:
            got = [r.path for r in refine(entries, first, new, now=NOW).rows.collect()]
            assert got == find(entries, new), (old, new)
    assert narrows(parse("report ext:txt"), parse("rep")) and not narrows(parse("re"), parse("rep"))


def test_tree_operators(spark, entries):
    totals = {r.path: r.subtree_size for r in entries.where("is_dir").collect()}
    assert totals["/data"] == (6 << 20) + 10 and totals["/"] == sum(n for _, n, _ in FILES) + 3 and totals["/emptydir"] == 0
    assert tree.subtree_size(entries, "/dupA").first()[0] == 6 and tree.selection_total(entries).first()[0] == totals["/"]
    nodes = spark.createDataFrame([(0, -1, "/"), (1, 0, "a"), (2, 1, "b"), (3, -1, "/x/y"), (4, 3, "z")], "id long, parent long, name string")
    assert {(r.id, r.path, r.depth) for r in tree.paths_from_parents(spark, nodes).collect()} == {(0, "/", 0), (1, "/a", 1), (2, "/a/b", 2), (3, "/x/y", 0), (4, "/x/y/z", 1)}


def test_listing_rules(spark):
    df = spark.createDataFrame([(*r, 1 if i else 2) for i, r in enumerate(rows_of(FILES))], SCHEMA + ", device long")
    kept = {r.path for r in select_listing(df, exclude=["/data", "/src/"], exclude_files="*.md;re?ort.*", device=1).collect()}
    assert not any(p.startswith(("/data/", "/src/")) or p.endswith(".md") for p in kept) and "/Report.PNG" not in kept and "/emptydir" in kept
    assert {r.path for r in select_listing(df, include_files="*.pdf").collect()} == {"/kind/manual.pdf", "/kind/SHOUT.PDF", "/emptydir"}


def test_crawl(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f.txt").write_text("xyz")
    (tmp_path / "g.TXT").write_text("")
    (tmp_path / "l").symlink_to("g.TXT")
    rows = {r.path.removeprefix(str(tmp_path)): (r.obj_type, r.size) for r in listing.crawl(spark, str(tmp_path)).collect()}
    assert {p: t for p, (t, _) in rows.items()} == {"": 2, "/a": 2, "/a/b": 2, "/a/b/f.txt": 1, "/g.TXT": 1, "/l": 5} and rows["/a/b/f.txt"][1] == 3
    assert listing.list_folder(str(tmp_path / "none")) is None
    found = ingest(listing.crawl(spark, str(tmp_path)))
    assert find(found, "f ext:txt") == [str(tmp_path / "a/b/f.txt")]


def test_differences_equal_a_rebuild(spark, entries):
    changed = [(p, n + 1 if p == "leaf.txt" else n, t) for p, n, t in FILES if not p.startswith("dupA/") and p != "notes.md"]
    changed += [("fresh/deep/x.md", 7, None), ("report.txt/now_a_folder.txt", 1, None)]
    changed = [f for f in changed if f[0] != "report.txt"]
    rows = [r for r in rows_of(changed)] + [(p, p.rsplit("/", 1)[-1], 0, 0, 0, 2, 0) for p in ("/fresh", "/fresh/deep", "/report.txt")]
    now = spark.createDataFrame(rows, SCHEMA)
    folders = [r.path for r in ingest(now).where("is_dir").collect()]
    known = {r[0] for r in rows}
    now = now.unionByName(spark.createDataFrame([(p, p.rsplit("/", 1)[-1], 0, 0, 0, 2, 0) for p in folders if p not in known and p != "/"], SCHEMA))
    changes = live.reconcile(entries, entries.where("is_dir").select("path"), lambda f: now)
    got, want = diff.apply(entries, changes), ingest(now)
    columns = ["path", "size", "obj_type", "subtree_size", "is_dupe", "is_empty_dir"]
    as_set = lambda df: {tuple(r) for r in tree.live(df).select(*columns).collect()}
    assert as_set(got) == as_set(want)
    log = diff.change_log(changes, 3)
    totals = {tuple(r) for r in diff.totals_after(tree.folder_totals(entries), log).collect()}
    assert totals == {tuple(r) for r in tree.folder_totals(got).collect() if r.subtree_size}
    assert tuple(diff.counters(changes).first()) == (5, 4, 1)


def test_snapshots(spark, entries, tmp_path):
    folder = str(tmp_path / "s")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, folder)
    assert snapshot.save(entries, folder, now=NOW)["generation"] == 0
    assert snapshot.save(live.unmount(entries, "/data"), folder, cursor=5, now=NOW)["generation"] == 1
    loaded = snapshot.load(spark, folder)
    assert find(loaded, "data") == [] and find(loaded, "report") == find(entries, "report")
    assert snapshot.must_rebuild(None, NOW) and not snapshot.must_rebuild(snapshot.read_manifest(spark, folder), NOW + 1000)
    assert snapshot.must_rebuild(snapshot.read_manifest(spark, folder), NOW + 4 * 86_400)
    manifest = tmp_path / "s" / "manifest-1.json"
    good = manifest.read_text()
    for damage in ("{", "{}", good.replace('"version": 2', '"version": 9'), good.replace('"base_name": "base=1', '"base_name": "base=7')):
        manifest.write_text(damage)
        for crc in manifest.parent.glob(".manifest*.crc"):
            crc.unlink()
        with pytest.raises(snapshot.SnapshotError):
            snapshot.load(spark, folder)
    manifest.write_text(good)
    assert snapshot.load(spark, folder).count() == loaded.count()


def test_filters_reach_the_scan(spark, entries, tmp_path):
    snapshot.save(entries, str(tmp_path / "s"))
    found = search(snapshot.load(spark, str(tmp_path / "s")), "report ext:txt,md size:>10 dm:month -folder:", now=NOW, scope_root="/src").rows.select("path")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PushedFilters") :]
    for part in ("GreaterThan(size,10)", "In(ext, [md,txt])", "StringStartsWith(path,/src/)", "GreaterThanOrEqual(mtime_ns"):
        assert part in scan, (part, scan)
    read = scan[scan.index("ReadSchema") :]
    assert "path_ufold" not in read and "crtime_ns" not in read and "subtree_size" not in read
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Arrow" not in plan


def test_stream_is_idempotent(spark, entries, tmp_path):
    folder, events = str(tmp_path / "s"), str(tmp_path / "events")
    snapshot.save(entries, folder)
    now = spark.createDataFrame(rows_of([f for f in FILES if f[0] != "data/tiny.txt"] + [("data/new.txt", 9, None)]), SCHEMA)
    spark.createDataFrame([(1, "/data/tiny.txt", False), (2, "/data/new.txt", False)], live.EVENTS).coalesce(1).write.parquet(events)
    stream = lambda: spark.readStream.schema(live.EVENTS).parquet(events)
    live.follow(spark, stream(), folder, lambda f: now, str(tmp_path / "c")).awaitTermination()
    first = snapshot.read_manifest(spark, folder)
    assert first["cursor"] == 2 and find(snapshot.load(spark, folder), "path:data/") == ["/data/big.bin", "/data/data.json", "/data/new.txt"]
    assert sorted(r.kind for r in live.read_log(spark, folder).collect()) == [diff.APPEND, diff.TOMBSTONE]
    live.follow(spark, stream(), folder, lambda f: now, str(tmp_path / "c2")).awaitTermination()  # replayed from the start
    assert snapshot.read_manifest(spark, folder) == first
    with pytest.raises(live.StaleBatch):
        live.apply_batch(spark, folder, spark.createDataFrame([(9, "/data/x", False)], live.EVENTS), lambda f: now, expected_generation=0)


@pytest.mark.parametrize(
    "total, deleted, now, last, want",
    [(50_000, 50_000, 1e9, 0, False), (100_000, 25_000, 1e9, 0, False), (100_000, 25_001, 1e9, 0, True), (100_000, 25_001, 599, 0, False), (100_000, 40_001, 1, 0, True), (100_000, 40_000, 1, 0, False)],
)
def test_compaction(total, deleted, now, last, want):
    assert diff.should_compact(total, deleted, now, last) is want


def test_requests(spark, entries):
    engine = Engine(entries)
    ask = lambda **r: engine.handle({"v": 1, **r}, now=NOW)
    assert ask(q="report", requestId="7") | {"queryMillis": 0} == {
        "v": 1, "requestId": "7", "ok": True, "total": 4, "truncated": False, "contentIncomplete": False, "queryMillis": 0, "paths": ["/my report 2.txt", "/Report.PNG", "/report.txt", "/reporting_x.txt"],
    }
    assert ask(q="report", limit=0)["paths"] == ["/my report 2.txt"] and ask(q="report", limit=1)["truncated"]
    assert ask(q="report", sort="size")["paths"][0] == "/Report.PNG" and ask(q="report", sort="size", asc=True)["paths"][0] == "/reporting_x.txt"
    assert ask(q="report ext:png", fields=["size"])["results"] == [{"path": "/Report.PNG", "name": "Report.PNG", "size": 300, "mtime": int(OLD * 1e9), "isDir": False}]
    assert "paths" not in ask(q="report", countOnly=True) and ask(q="x", scopeRoot="/none") == {"v": 1, "requestId": None, "ok": True, "total": 0, "truncated": False, "paths": []}
    for bad, code in ((dict(q="a", v=2), "unsupported_version"), (dict(q="a", mode="z"), "bad_request"), (dict(q="a", sort="z"), "bad_request"), ({}, "bad_request")):
        assert engine.handle(bad)["error"]["code"] == code
    assert engine.tool({"id": 1, "method": "tools/list"})["result"]["tools"][0]["name"] == "search"
    called = engine.tool({"id": 2, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "report", "count_only": True}}}, now=NOW)
    assert called["result"]["content"][0]["text"] == "4"
    assert "error" in engine.tool({"id": 3, "method": "x"}) and "error" in engine.tool({"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "a", "mode": "z"}}})


def test_server_and_the_way_back_to_the_snapshot(spark, entries, tmp_path, capsys):
    path = str(tmp_path / "socket")
    snapshot.save(entries, str(tmp_path / "s"))
    assert server.ask(path, {"q": "report"}) is None
    running = server.Server(Engine(entries), path, NOW).start()
    try:
        got = server.ask(path, {"v": 1, "q": "report", "requestId": 7, "limit": 2, "fields": ["path", "size"]})
        assert (got["requestId"], got["ok"], got["total"], got["truncated"], len(got["results"])) == (7, True, 4, True, 2)
        with socket.socket(socket.AF_UNIX) as s:
            s.connect(path)
            s.sendall(b'no json\n[1]\n{"q": "leaf", "countOnly": true}\n{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}\n')
            lines = [json.loads(s.makefile("rb").readline()) if i == 0 else None for i in range(1)]
            assert lines[0]["error"]["code"] == "bad_request"
        for line, want in ((b"[1]", False), (b'{"q": "leaf", "countOnly": true}', True)):
            assert server.answer(Engine(entries), line, NOW)["ok"] is want
        assert main(["report", "--count", "--socket", path], spark) == 0  # from the server
    finally:
        running.shutdown()
        running.server_close()
    assert main(["report", "--count", "--socket", path, "--snapshot", str(tmp_path / "s")], spark) == 0  # from the snapshot
    assert main(["report", "--snapshot", str(tmp_path / "none")], spark) == 1
    assert capsys.readouterr().out == "4\n4\n"


def test_command_line(spark, entries, tmp_path, capsys):
    snapshot.save(entries, str(tmp_path / "s"))
    run = lambda *a: (main([*a, "--snapshot", str(tmp_path / "s")], spark, __import__("sys").stdout), capsys.readouterr().out)
    assert run("report", "ext:png") == (0, "/Report.PNG\n") and run("report", "--count") == (0, "4\n")
    assert run("leaf", "-0") == (0, "/leaf.txt\0/src/a/b/c/d/leaf.txt\0")
    assert json.loads(run("report", "--json", "-n", "1", "--sort", "size")[1])["results"][0]["path"] == "/Report.PNG"


def test_exports(spark, tmp_path):
    df = ingest(spark.createDataFrame([('/a,"b".txt', 'a,"b".txt', 3, 10**18, 0, 1, 0)], SCHEMA))
    lines = {r.line for r in export.csv_lines(df).collect()}
    assert '"a,""b"".txt","/a,""b"".txt",3,2001-09-09 01:46:40,' in lines and "/,/,,," in lines
    export.write_csv(df, str(tmp_path / "csv"))
    export.write_paths(df, str(tmp_path / "paths"))
    assert {r.value for r in spark.read.text(str(tmp_path / "paths")).collect()} == {"/", '/a,"b".txt'}
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert {r.Name for r in back.collect()} == {"/", 'a,"b".txt'}
    assert {(r.name, r.kind, r.extension) for r in export.detail(df).collect()} == {("/", "Folder", ""), ('a,"b".txt', "TXT file", "txt")}


def test_fingerprints(spark, entries):
    from treesift.functions import fingerprint as P

    assert P.fnv1a("") == 0xCBF29CE484222325 and P.fnv1a("a") == 0xAF63DC4C8601EC8C
    assert P.character_mask("aA9") == 1 | 1 << 35 and P.character_mask(".") == 1 << (36 + 46 % 28)
    masked = entries.withColumn("mask", P.mask_column(F.col("name_fold")))
    for term in ("report", "é", "md"):
        lost = masked.where(F.contains("name_fold", F.lit(term)) & ~P.may_contain(F.col("mask"), term))
        assert lost.isEmpty()


def test_a_newer_job_replaces_the_older(spark):
    import threading
    import time

    from treesift.operators.supersede import Latest

    latest, seen = Latest(spark), []

    def slow():
        try:
            latest.run(lambda: spark.range(10**13).selectExpr("sum(id * id % 7)").collect())
        except Exception as e:
            seen.append(e)

    thread = threading.Thread(target=slow)
    thread.start()
    time.sleep(2)
    assert latest.run(lambda: spark.range(5).count()) == 5
    thread.join(30)
    assert not thread.is_alive() and len(seen) == 1


def test_history_is_kept(spark, tmp_path):
    rows = spark.createDataFrame([("/a", 3, 1.5), ("/é", 1, 2.0)], "path string, count long, last_run double")
    history.save(rows, str(tmp_path / "h"))
    assert {tuple(r) for r in history.load(spark, str(tmp_path / "h")).collect()} == {tuple(r) for r in rows.collect()}


def test_mounts_and_large_contents(spark, entries):
    other = ingest(spark.createDataFrame([("/mnt/x/new.txt", "new.txt", 7, 1, 1, 1, 0), ("/mnt", "mnt", 0, 1, 1, 2, 0)], SCHEMA))
    both = live.mount(live.unmount(entries, "/data"), other.where("path like '/mnt%'"))
    assert find(both, "new|data") == ["/mnt/x/new.txt"]
    contents = spark.createDataFrame([("/data/big.bin", "abc"), ("/leaf.txt", "abc")], "path string, content string")
    r = search(entries, "content:abc", contents=contents, options=SearchOptions(content_max_bytes=1 << 20))
    assert r.total() == 1 and r.content_skipped_large() == 1


def test_empty_listing(spark):
    empty = ingest(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and find(empty, "a", sort="relevance", ascending=False) == []
    assert search(empty, "").total() == 0 and F is not None


def test_whole_tree_queries(spark):
    """Over every entry, of any extension and depth, against the stored columns and plain Python."""
    import __spark_entry__ as E

    from treesift import queries as engine

    folder = "/root/testdata/sf0.001"
    run = lambda name: E.queries()[name](spark, folder).collect()
    rows = engine.entries(spark, folder).select("path", "depth", "name").collect()
    assert len({r.path for r in rows}) == len(rows) and max(r.depth for r in rows) > 3
    assert sorted((r.path, r.depth) for r in run("tree_paths")) == sorted((r.path, r.depth) for r in rows)
    want = [(r.path, "/".join(r.path.split("/")[:n]) or "/") for r in rows if r.path != "/" for n in range(1, len(r.path.split("/")))]
    assert sorted((r.path, r.ancestor) for r in run("tree_ancestors")) == sorted(want)
    spans = [(r.path, a, n) for r in rows for a, n in highlight.spans(r.name, "report -x e ext:md")]
    assert sorted(map(tuple, run("highlight_spans"))) == sorted(spans) and len({p for p, _, _ in spans}) < len(rows)
    assert len(run("csv_lines")) == len(rows) and any('""' in r.line for r in run("csv_lines"))
    empty = {"regex_invalid", "scope_missing"}  # by their meaning
    for name in ("term_phrase", "term_unknown_filter", "ext_trailing_dot", "runcount_order", "relevance_or", "relevance_whole_word", "ingest_device", *empty):
        assert bool(run(name)) != (name in empty), name


def test_queries_whose_sql_has_no_limit_return_every_row(spark):
    from treesift import queries
    from treesift.operators.search import LIMIT

    n = LIMIT + 1
    name = F.concat(F.lit("report_"), "id", F.lit(".jpg"))
    rows = spark.range(n).select(F.concat(F.lit("/d/"), name).alias("path"), name.alias("name"), *(F.col("id").alias(c) for c in ("size", "mtime_ns", "crtime_ns")), F.lit(1).alias("obj_type"), F.lit(0).cast("long").alias("flags"))
    queries._entries[(spark.sparkContext.applicationId, "many")] = ingest(rows)
    assert queries.QUERIES["csv_rows"](spark, "many").count() == n
    for query in ("relevance_exact", "relevance_or", "relevance_whole_word"):
        found = queries.QUERIES[query](spark, "many").select("path", "rank", "score").toPandas()
        assert found["rank"].tolist() == list(range(1, n + 1)) and found.path.is_unique, query
        wanted = found.assign(down=-found.score, fold=found.path.str.slice(3)).sort_values(["down", "fold"])
        assert wanted["rank"].is_monotonic_increasing, query
