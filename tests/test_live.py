"""Live updates, crawls and snapshots: what fails deletes nothing, and a batch costs what it changes."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from treesift.operators import diff, tree
from treesift.operators.ingest import ingest
from treesift.sources import listing, snapshot
from treesift.streaming import live

SCHEMA = "path string, name string, size long, mtime_ns long, crtime_ns long, obj_type int, flags long"
COLUMNS = ["path", "size", "obj_type", "flags", "subtree_size", "is_dupe", "is_empty_dir", "is_hidden", "ext", "depth", "parent_path"]


def rows_of(files, folders=()):
    out = [(p, p.rsplit("/", 1)[-1], n, 7, 5, 1, 0) for p, n in files]
    return out + [(p, p.rsplit("/", 1)[-1], 0, 0, 0, 2, 0) for p in folders]


def table(spark, files, folders=()):
    return spark.createDataFrame(rows_of(files, folders), SCHEMA)


def events(spark, *rows):
    return spark.createDataFrame([(s, p, bool(m)) for s, p, m in rows], live.EVENTS)


def state(entries):
    return {tuple(r) for r in tree.live(entries).select(*COLUMNS).collect()}


def folders_of(files):
    out = set()
    for p, _ in files:
        parts = p.split("/")
        out |= {"/".join(parts[:i]) for i in range(2, len(parts))}
    return sorted(out)


FILES = [("/a/x.txt", 1), ("/a/b/y.txt", 2), ("/a/b/c/z.txt", 4), ("/d/x.txt", 8), ("/e/only.md", 16)]


def test_batches_equal_a_rebuild(spark, tmp_path):
    """After each batch of a series the snapshot is what a new crawl would give, deltas or not."""
    folder = str(tmp_path / "s")
    snapshot.save(ingest(table(spark, FILES)), folder, now=1.0)
    series = [
        FILES[1:] + [("/a/new.txt", 32)],  # one goes, one comes
        [("/a/b/y.txt", 3), ("/d/x.txt", 8), ("/e/only.md", 16), ("/a/new.txt", 32)],  # a folder goes, a size changes
        [("/d/x.txt", 8), ("/f/g/h/x.txt", 64), ("/e/only.md", 16), ("/a/new.txt", 32), ("/a/b", 5)],  # deep new folders; a folder becomes a file
        [("/d/x.txt", 8), ("/f/g/h/x.txt", 64), ("/e/only.md", 16), ("/a/new.txt", 32), ("/a/b/again.txt", 6)],  # and back
        [("/d/x.txt", 8)],
    ]
    for number, files in enumerate(series, 1):
        now = table(spark, files, folders_of(files))
        manifest = live.apply_batch(spark, folder, events(spark, (number, "/a", True)), lambda f: now, now=1.0)
        assert manifest["generation"] >= number and manifest["cursor"] == number
        want = state(ingest(table(spark, files, [f for f in ("/a", "/e") if not any(p.startswith(f + "/") for p, _ in files)])))
        got = state(snapshot.load(spark, folder))
        want = {r for r in want if r[0] in {g[0] for g in got}}  # folders that have gone are gone
        assert got == want, number
        counts = diff.row_counts(snapshot.load(spark, folder)).first()
        assert (manifest["rows"], manifest["deleted"]) == (counts.live + counts.deleted, counts.deleted)


def test_a_failed_listing_deletes_nothing(spark, tmp_path):
    folder = str(tmp_path / "s")
    snapshot.save(ingest(table(spark, FILES)), folder)
    before = state(snapshot.load(spark, folder))
    nothing, broken = table(spark, []), spark.createDataFrame([("/a/b",), ("/a",)], "path string")
    live.apply_batch(spark, folder, events(spark, (1, "/a/b/y.txt", False), (2, "/a/b", False)), lambda f: (nothing, broken))
    assert state(snapshot.load(spark, folder)) == before
    # the folders that failed are looked at again with the next batch, whatever it is about
    files = [f for f in FILES if f[0] != "/a/b/y.txt"]
    now = table(spark, files, folders_of(files))
    live.apply_batch(spark, folder, events(spark, (3, "/d/x.txt", False)), lambda f: (now, broken.limit(0)))
    assert {r[0] for r in before} - {r[0] for r in state(snapshot.load(spark, folder))} == {"/a/b/y.txt"}


def test_new_folders_of_any_depth_are_followed(spark, tmp_path):
    folder, deep = str(tmp_path / "s"), "/a" + "/n" * 66
    snapshot.save(ingest(table(spark, FILES)), folder)
    files = [*FILES, (f"{deep}/leaf.txt", 128)]
    now = table(spark, files, folders_of(files)).coalesce(1).cache()
    live.apply_batch(spark, folder, events(spark, (1, "/a/n", False)), lambda f: now)
    got = {r.path: r for r in tree.live(snapshot.load(spark, folder)).collect()}
    assert f"{deep}/leaf.txt" in got and got["/a"].subtree_size == 1 + 2 + 4 + 128 and got[deep].subtree_size == 128


def test_the_folders_themselves_are_listed(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "f.txt").write_text("xyz")
    folder = str(tmp_path / "s")
    snapshot.save(ingest(listing.crawl(spark, str(root))), folder)
    (root / "a" / "f.txt").unlink()
    (root / "a" / "b" / "g.txt").write_text("12345")
    live.apply_batch(spark, folder, events(spark, (1, str(root / "a" / "f.txt"), False), (2, str(root / "a" / "b" / "g.txt"), False)), listing.relist)
    got = {r.path.removeprefix(str(root)): r.size for r in tree.live(snapshot.load(spark, folder)).where(f"path like '{root}/%' and not is_dir").collect()}
    assert got == {"/a/b/g.txt": 5}
    rows, failed = listing.relist(spark.createDataFrame([(str(root / "a"),), (str(root / "none"),)], "path string"))
    assert [r.name for r in rows.collect()] == ["b"] and [r.path for r in failed.collect()] == [str(root / "none")]


def test_generations_and_new_bases(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    snapshot.save(ingest(table(spark, FILES)), folder)
    monkeypatch.setattr(snapshot, "MAX_DELTAS", 3)
    monkeypatch.setattr(snapshot, "DELTA_SHARE", (100, 1))
    bases = []
    for i in range(1, 8):
        files = [*FILES, (f"/a/extra{i}.txt", i)]
        now = table(spark, files, folders_of(files))
        bases.append(live.apply_batch(spark, folder, events(spark, (i, "/a/x.txt", False)), lambda f: now)["base"])
    assert bases[0] == 0 and len(set(bases)) == 3  # a new base after each three deltas
    names = sorted(os.listdir(folder))
    assert not any(n.startswith("base=0-") for n in names) and sum(n.startswith("base=") for n in names) == 2
    # a second writer of the same generation fails, and what is in force stays whole
    manifest = snapshot.read_manifest(spark, folder)
    with pytest.raises(snapshot.SnapshotError):
        snapshot._publish(spark, folder, manifest)
    assert snapshot.read_manifest(spark, folder) == manifest
    # a writer that dies before its manifest is there leaves the old generation in force
    snapshot._write(snapshot.load(spark, folder).limit(1), f"{folder}/base=99-dead", ordered=True)
    assert snapshot.read_manifest(spark, folder) == manifest and snapshot.load(spark, folder).count() > 1


def test_old_snapshots_are_rebuilt(spark, tmp_path):
    folder, now = str(tmp_path / "s"), time.time()
    snapshot.save(ingest(table(spark, FILES)), folder, cursor=9, now=now - 4 * 86_400)
    fresh = table(spark, [("/new/f.txt", 1)])
    query = live.follow(spark, spark.readStream.format("rate").load().selectExpr("value AS seq", "'/' AS path", "false AS must_scan").where("seq < 0"), folder, lambda f: fresh, str(tmp_path / "c"), interval="1 second", recrawl=lambda: fresh, throttle=True)
    query.stop()
    manifest = snapshot.read_manifest(spark, folder)
    assert manifest["cursor"] == 9 and {r.path for r in snapshot.load(spark, folder).where("not is_dir").collect()} == {"/new/f.txt"}
    assert live.rebuild(spark, folder, lambda: table(spark, FILES)) == manifest  # young enough to catch up
    assert live.rescan_due(0, 3600) and not live.rescan_due(0, 3599)


def test_offline_roots_and_phases(spark, tmp_path):
    entries = ingest(table(spark, FILES))
    assert state(live.unmount(entries, "/a", keep_offline=True)) == state(entries)
    assert state(live.unmount(entries, "/a")) == state(ingest(table(spark, [f for f in FILES if not f[0].startswith("/a/")])))
    manifest = live.phased(spark, table(spark, FILES[:3]), table(spark, FILES[3:]), str(tmp_path / "s"))
    assert manifest["generation"] == 1 and state(snapshot.load(spark, str(tmp_path / "s"))) == state(entries)


def test_few_and_many_removed_folders(spark, monkeypatch):
    entries = ingest(table(spark, [(f"/r{i}/s/f.txt", 1) for i in range(20)])).cache()
    gone = spark.createDataFrame([(f"/r{i}",) for i in range(15)], "path string")
    want = {r.path for r in entries.collect() if any(r.path == f"/r{i}" or r.path.startswith(f"/r{i}/") for i in range(15))}
    assert {r.path for r in diff.below(entries, gone).collect()} == want and len(want) == 45
    monkeypatch.setattr(diff, "FEW_FOLDERS", 3)
    assert {r.path for r in diff.below(entries, gone).collect()} == want
    assert diff.below(entries, gone.limit(0)).count() == 0


def test_crawl_leaves_out_while_walking(spark, tmp_path, monkeypatch):
    for p in ("a/b/c", "skip/deep", "mnt/other", "wide"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "f").write_text("x")
    for i in range(50):
        (tmp_path / "wide" / f"d{i}").mkdir()
    seen = []
    plain = listing.list_folder
    monkeypatch.setattr(listing, "list_folder", lambda p: seen.append(p) or plain(p))
    reader = listing._CrawlReader({"path": str(tmp_path), "exclude": f'["{tmp_path}/skip", "{tmp_path}/mnt"]', "tasks": "4"})
    parts = reader.partitions()
    found = [r[0].removeprefix(str(tmp_path)) for part in parts for r in reader.read(part)]
    assert len(parts) == 4 and len(found) == len(set(found)) == 1 + 3 + 1 + 1 + 50 + 1
    assert not any("skip" in p or "mnt" in p for p in [*found, *seen])
    rows = listing.crawl(spark, str(tmp_path), exclude=[f"{tmp_path}/skip"], mounts=[f"{tmp_path}/mnt"]).collect()
    assert sorted(r.path.removeprefix(str(tmp_path)) for r in rows) == sorted(found)


def test_errors_of_a_crawl_are_counted(spark, tmp_path, monkeypatch):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "f").write_text("x")
    plain = listing.list_folder
    monkeypatch.setattr(listing, "list_folder", lambda p: None if p.endswith("/b") else plain(p))
    reader = listing._CrawlReader({"path": str(tmp_path)})
    rows = spark.createDataFrame([r for part in reader.partitions() for r in reader.read(part)], listing.LISTING)
    stats = listing.timed_stats(rows)
    assert {k: stats[k] for k in ("files", "folders", "links", "errors")} == {"files": 1, "folders": 3, "links": 0, "errors": 1} and stats["seconds"] > 0


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from treesift.operators.ingest import ingest
from treesift.operators.search import search
from treesift.sources.listing import crawl
e = ingest(crawl(spark, {tree!r}))
print("found", [r.name for r in search(e, "cafe", mode="fuzzy", sort="relevance", ascending=False).rows.collect()])
"""


def test_workers_get_the_code_without_a_search_path(tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "Café.txt").write_text("x")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=repo, tree=str(tmp_path / "tree"))
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found ['Café.txt']" in out.stdout, out.stderr[-2000:]
    assert F is not None
