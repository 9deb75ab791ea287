from __future__ import annotations

import json
import os

import pytest

from cairnlake import schema
from cairnlake.catalog import Catalog
from cairnlake.operators import ingest, manifest, policy, reconcile, reports, scope
from cairnlake.sources import enrich, files
from tests import edge


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def cat(spark):
    return edge.catalog(spark)


def test_scope_and_listings(cat):
    assert ids(scope.candidates(cat, scope="/r/a", include_excluded=True).orderBy("id")) == [1, 2, 3]
    assert ids(scope.candidates(cat, scope="/r/a/p", include_excluded=True).orderBy("id")) == [1, 2]
    assert ids(scope.candidates(cat, scope="/r/a_b", include_excluded=True)) == [4]
    assert ids(scope.ls(cat)) == [1, 3, 4]
    assert ids(scope.ls(cat, archive_state="archived")) == [1, 4]
    assert ids(scope.ls(cat, archive_state="unarchived")) == [3]
    assert ids(scope.ls(cat, archive_state="unhashed")) == []
    assert ids(scope.ls(cat, archive_state="unhashed", include_excluded=True)) == [2]
    assert [(r["id"], r["archive_path"]) for r in scope.ls(cat, archive_state="show").collect()] == [(1, "/v/x/keep/IMG.JPG"), (4, "/v/x/keep/IMG.JPG")]
    with pytest.raises(ValueError):
        scope.ls(cat, archive_state="any")
    assert scope.root_of(cat, "/r/a/p")["id"] == 1 and scope.root_of(cat, "/r/ab") is None
    assert scope.resolve_root(cat, "id:3", "archive")["path"] == "/v/x"
    with pytest.raises(LookupError):
        scope.resolve_root(cat, "path:/r/a", "archive")


def test_coverage(cat):
    rows = {r["path"]: r for r in reports.coverage(cat, by_root=True).collect()}
    a, b = rows["/r/a"], rows["/r/a_b"]
    assert (a["total"], a["excluded"], a["hashed"], a["hashed_pct"], a["archived"], a["archived_pct"], a["unarchived"]) == (3, 1, 2, 100.0, 1, 50.0, 1)
    assert (b["total"], b["excluded"], b["hashed"], b["archived"]) == (1, 0, 1, 1)
    o = reports.coverage_overall(reports.coverage(cat, by_root=True)).first()
    assert (o["total"], o["excluded"], o["hashed"], o["hashed_pct"], o["archived"], o["archived_pct"], o["unarchived"]) == (4, 1, 3, 100.0, 2, 66.7, 1)
    assert reports.coverage(cat, archive="id:3").first()["archived"] == 2


def test_fact_reports(cat):
    keys = {r["key"]: r["cnt"] for r in reports.fact_keys(cat).collect()}
    assert keys == {"source.ext": 3, "source.size": 3, "source.mtime": 3, "source.path": 3, "content.hash.sha256": 3, "content.Make": 2, "content.n": 2, "content.code": 1, "content.shot": 1, "content.tags": 1, "content.note": 1}
    assert [(r["value"], r["cnt"]) for r in reports.fact_values(cat, "content.Make").collect()] == [("Apple", 2), ("Nikon", 1), ("(no value)", 1)]
    assert reports.fact_values(cat, "content.n").first()["value"] == "3.0"
    assert reports.fact_values(cat, "content.shot").first()["value"] == "2024-01-15 00:00:00"
    size = {r["value"]: r["cnt"] for r in reports.fact_values(cat, "source.size", include_excluded=True).collect()}
    assert size == {"< 1 KB": 2, "1 KB - 1 MB": 1, "1 MB - 10 MB": 1}
    year = {r["value"]: r["cnt"] for r in reports.fact_values(cat, "source.mtime", include_excluded=True).collect()}
    assert year == {"2024": 2, "1970": 1, "1969": 1}
    assert "Apple" in reports.table_text(reports.fact_values(cat, "content.Make"), [10, 5, 6])


def test_policy(cat):
    assert ids(policy.exclude_preview(cat, ["source.ext = jpg"])) == [1]
    after = policy.exclude_set(cat, ["source.ext = jpg"], now=5)
    assert ids(policy.exclude_list(after)) == [1, 2]
    assert ids(policy.exclude_list(policy.exclude_clear(after, ["source.ext = jpg"]))) == [2]
    assert policy.delete_preview(cat, "content.Make", "source").first().asDict() == {"facts": 1, "entities": 1}
    assert policy.delete_preview(cat, "content.Make", "object").first().asDict() == {"facts": 1, "entities": 1}
    assert policy.delete_facts(cat, "content.Make", "object").facts.count() == 11
    with pytest.raises(ValueError):
        policy.delete_preview(cat, "policy.exclude", "source")
    assert [(r["entity_id"], r["key"]) for r in policy.stale_facts(cat).collect()] == [(3, "content.note")]
    assert policy.prune_stale(cat).facts.count() == 11


def test_manifest(cat, spark, tmp_path):
    made = manifest.generate(cat, ["content.hash.sha256?"], "/v/x/in", "{filename}")
    assert ids(made.sources) == [3] and ids(made.archived) == [1, 4] and made.excluded.first()[0] == 0
    assert manifest.generate(cat, ["source.size>0"]).excluded.first()[0] == 1
    with pytest.raises(ValueError):
        manifest.generate(cat, [])
    with pytest.raises(LookupError):
        manifest.generate(cat, ["source.size>0"], "/r/a")
    everything = manifest.generate(cat, ["content.hash.sha256?"], "/v/x", "{hash_short}", include_archived=True)
    only = lambda p: manifest.plan_apply(cat, manifest.Manifest(everything.sources.where("id in (1, 3, 4)"), everything.archived, everything.excluded, pattern=p, archive_root_id=3))
    assert only("{filename}").collisions.count() == 0
    assert [(r["dest"], r["ids"]) for r in only("{hash_short}").collisions.collect()] == [("aa", [1, 4])]
    assert [r["problem"] for r in only("{nothing}/{id}").unresolved.collect()] == ["{nothing}"] * 3
    assert [r["dest"] for r in only("{content_Make}-{stem}.{ext}").rows.collect()] == ["Apple-IMG.JPG", "Apple-é.png"]
    assert ids(only("{filename}").in_destination) == [1, 4]
    path = str(tmp_path / "m.toml")
    files.write_manifest(made, path)
    back = files.read_manifest(spark, path)
    assert [tuple(r) for r in back.sources.drop("facts").collect()] == [tuple(r) for r in made.sources.drop("facts").collect()]
    assert json.loads(back.sources.first()["facts"]["content.shot"]) == 1705276800 and back.pattern == "{filename}" and back.archive_root_id == 3 and back.base_dir == "in"


def test_import_scenario(cat, spark):
    lines = [
        '{"source_id":2,"basis_rev":0,"facts":{"mime":"text/plain"}}',
        '{"source_id":2,"basis_rev":0,"facts":{"hash.sha256":"cc","source.ext":"x"}}',
        '{"source_id":3,"basis_rev":0,"facts":{"a":1}}',
        '{"source_id":5,"basis_rev":0,"facts":{"a":1}}',
        "oops",
        '{"source_id":99,"basis_rev":0,"facts":{"a":1}}',
        "   ",
    ]
    done = ingest.import_facts(cat, spark.createDataFrame(list(enumerate(lines)), "ln long, line string"), now=7)
    assert done.counters.first().asDict() == {"lines": 6, "imported": 2, "stale": 1, "reserved": 1, "archived": 1, "created": 1, "promoted": 3}
    assert [r["outcome"] for r in done.outcomes.orderBy("ln").collect()] == ["ok", "ok", "stale", "archived", "malformed", "not_found"]
    facts = {(r["entity_type"], r["entity_id"], r["key"]): r["value_text"] for r in done.catalog.facts.collect()}
    assert facts["object", 103, "content.hash.sha256"] == "cc" and facts["object", 103, "content.mime"] == "text/plain" and facts["object", 103, "content.city"] == "É"
    assert ("source", 2, "content.city") not in facts and facts["source", 2, "policy.exclude"] == "true"
    assert done.catalog.sources.where("id = 2").first()["object_id"] == 103 and done.catalog.objects.count() == 4
    assert schema.violations(done.catalog).collect() == []
    again = ingest.import_facts(done.catalog, spark.createDataFrame(list(enumerate(lines)), "ln long, line string"), now=7)
    key = lambda c: sorted((r["entity_type"], r["entity_id"], r["key"], r["value_text"] or "") for r in c.facts.collect())
    assert key(again.catalog) == key(done.catalog)


def test_import_types(cat, spark):
    line = '{"source_id":4,"basis_rev":0,"observed_at":9,"facts":{"a":"2024-01-15T00:00:00Z","b":"2024-01-15","c":"2024:01:15 00:00:00","d":1,"e":2.5,"f":true,"g":null,"h":{"x":[1]},"i":"100","hash.sha256":5}}'
    done = ingest.import_facts(cat, spark.createDataFrame([(1, line)], "ln long, line string"), now=7)
    got = {r["key"].removeprefix("content."): (r["value_text"], r["value_num"], r["value_time"], r["value_json"]) for r in done.catalog.facts.where("entity_type = 'object' and entity_id = 100 and observed_at = 9").collect()}
    assert got["a"] == got["c"] == (None, None, 1705276800, None) and got["b"] == ("2024-01-15", None, None, None)
    assert got["d"][1] == 1.0 and got["e"][1] == 2.5 and got["f"][1] == 1.0 and got["g"][0] == "" and json.loads(got["h"][3]) == {"x": [1]} and got["i"][0] == "100" and got["hash.sha256"][1] == 5.0
    assert done.catalog.objects.count() == 3


def test_scan(cat, spark):
    rows = [(1, "p/IMG.JPG", 1, 11, 1001, 1705276800), (1, "q/arc.tar.gz", 1, 13, 1048576, -1), (2, "p/é.png", 1, 14, 5, 1705276800), (2, "new", 1, 99, 1, 1), (2, "link", 1, 13, 1, 1)]
    done = reconcile.scan(cat, spark.createDataFrame(rows, files.LISTING), [1, 2], now=50)
    assert {(r["rel_path"], r["action"], r["basis_rev"]) for r in done.actions.collect()} == {("p/IMG.JPG", "updated", 1), ("q/arc.tar.gz", "moved", 1), ("p/é.png", "unchanged", 0), ("new", "new", 0), ("link", "new", 0)}
    assert {r["action"]: r["count"] for r in done.counters.collect()} == {"updated": 1, "moved": 1, "unchanged": 1, "new": 2, "missing": 1}
    after = {r["id"]: r for r in done.catalog.sources.collect()}
    assert after[2]["present"] == 0 and after[3]["rel_path"] == "q/arc.tar.gz" and after[5]["present"] == 1 and sorted(after)[-2:] == [8, 9]
    part = reconcile.missing(cat, reconcile.actions(cat, spark.createDataFrame([], files.LISTING)), [1], "p")
    assert sorted(ids(part)) == [1, 2]
    with pytest.raises(ValueError):
        reconcile.add_root(cat, "/r", "source")
    assert reconcile.add_root(cat, "/r/a_c", "archive").roots.count() == 4


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "src/d").mkdir(parents=True)
    (tmp_path / "src/d/x.txt").write_text("hello")
    (tmp_path / "src/y.txt").write_text("there")
    (tmp_path / "dst").mkdir()
    cat = reconcile.add_root(reconcile.add_root(Catalog.empty(spark), str(tmp_path / "src"), "source"), str(tmp_path / "dst"), "archive")
    cat = reconcile.scan(cat, files.listing(spark, 1, str(tmp_path / "src")), [1], now=1).catalog
    cat.save(str(tmp_path / "cat"))
    cat = Catalog.load(spark, str(tmp_path / "cat"))
    lines = enrich.fact_lines(enrich.run_command(scope.worklist(cat), ["sh", "-c", "sha256sum {} | cut -c1-64"]), "fact", "hash.sha256", now=2)
    (tmp_path / "lines.jsonl").write_text("".join(r["line"] + "\n" for r in lines.collect()))
    ingest.import_facts(cat, files.read_lines(spark, str(tmp_path / "lines.jsonl")), now=2).catalog.save(str(tmp_path / "cat2"))
    done = Catalog.load(spark, str(tmp_path / "cat2"))
    made = manifest.generate(done, ["content.hash.sha256?"], str(tmp_path / "dst/in"), "{stem}-{hash_short}.{ext}")
    after, counts = files.execute(done, manifest.plan_apply(done, made), 2, now=3)
    assert counts == {"copied": 2} and len(list((tmp_path / "dst/in").iterdir())) == 2
    assert reports.coverage(after).first()["archived"] == 2
    assert sorted(r["hash"] for r in files.sha256_of_files(spark, str(tmp_path / "src")).collect()) == sorted(r["hash_value"] for r in done.objects.collect())
    assert sorted(r["rel_path"] for r in files.listing_of_store(spark, 1, str(tmp_path / "src")).collect()) == ["d/x.txt", "y.txt"]


def test_enrich_modes(spark):
    df = spark.createDataFrame([(1, 0, "a = 1\n=x\nno\na=2=3\n b=", None), (2, 0, None, "bad")], enrich.OUTPUT)
    assert [json.loads(r["line"])["facts"] for r in enrich.fact_lines(df, now=1).collect()] == [{"a": "2=3", "b": ""}]
    df = spark.createDataFrame([(1, 0, '{"x": 1}', None), (2, 0, "[1]", None), (3, 0, "{bad", None)], enrich.OUTPUT)
    assert [json.loads(r["line"])["facts"] for r in enrich.fact_lines(df, "json", now=1).collect()] == [{"x": 1}]
    failed = enrich.run_command(spark.createDataFrame([(1, 0, "/nowhere")], "source_id long, basis_rev long, path string"), ["cat", "{}"]).first()
    assert failed["stdout"] is None and failed["error"]


def test_stream(spark, tmp_path):
    from cairnlake.streaming.imports import import_stream, snapshot

    edge.catalog(spark).save(str(tmp_path / "start"))
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox/1.jsonl").write_text('{"source_id":4,"basis_rev":0,"facts":{"a":1}}\n')
    query = import_stream(spark, str(tmp_path / "inbox"), str(tmp_path / "cat"), str(tmp_path / "cp"), str(tmp_path / "start"))
    query.awaitTermination(120)
    after = Catalog.load(spark, snapshot(str(tmp_path / "cat"), 0))
    assert after.facts.where("key = 'content.a'").first()["entity_id"] == 100


def test_scan_of_hard_links(cat, spark):
    """Rows and files of one inode are matched one to one."""
    from cairnlake import schema

    rows = [(k, 1, f"a{k}", 1, 50, 9, 0, 0, 0, 0, 1, None) for k in (1, 2)] + [(3, 1, "b", 1, 60, 9, 0, 0, 0, 0, 1, None), (4, 1, "c", None, None, 9, 0, 0, 0, 0, 1, None)]
    linked = Catalog.of(cat.roots, spark.createDataFrame(rows, schema.SOURCES), cat.objects.limit(0), cat.facts.limit(0))
    listing = spark.createDataFrame([(1, "z", 1, 50, 9, 0), (1, "x", 1, 60, 9, 0), (1, "y", 1, 60, 9, 0), (1, "n1", None, None, 9, 0), (1, "n2", None, None, 9, 0)], files.LISTING)
    done = reconcile.scan(linked, listing, [1], now=1)
    assert {(r["rel_path"], r["action"], r["id"]) for r in done.actions.collect()} == {("z", "moved", 1), ("x", "moved", 3), ("y", "new", None), ("n1", "new", None), ("n2", "new", None)}
    here = [(r["root_id"], r["rel_path"]) for r in done.catalog.sources.where("present = 1").collect()]
    assert len(here) == len(set(here)) == 5 and done.catalog.sources.where("id = 2").first()["present"] == 0


def _cli(capsys, *argv):
    from cairnlake import cli

    capsys.readouterr()
    assert cli.main(list(argv)) == 0
    got = capsys.readouterr()
    return [x for x in got.out.splitlines() if x], got.err


def test_commands(spark, tmp_path, capsys, monkeypatch):
    import io

    from cairnlake import cli

    (tmp_path / "src/d").mkdir(parents=True)
    for name, text in [("d/a.txt", "same"), ("b.txt", "same"), ("c.bin", "other")]:
        (tmp_path / "src" / name).write_text(text)
    (tmp_path / "dst").mkdir()
    db, src, dst = ["--db", str(tmp_path / "db")], str(tmp_path / "src"), str(tmp_path / "dst")
    assert _cli(capsys, *db, "scan", "--add", src)[0] == ["new\t3"]
    _cli(capsys, *db, "scan", "--add", "--role", "archive", dst)
    for bad in (["scan", "--add", src], ["scan", "--role", "archive", src], ["scan", str(tmp_path)]):
        with pytest.raises(SystemExit):
            cli.main([*db, *bad])
    for bad in (["ls", "--archived", "--unhashed"], ["ls", "--unarchived", "--unhashed"], ["apply", "m", "--rename", "--move"], ["exclude-list", "--dry-run"], ["process", "--kv", "--json", "x"], ["process", "x"]):
        with pytest.raises(SystemExit):
            cli.main([*db, *bad])
    monkeypatch.chdir(src)
    lines, said = _cli(capsys, *db, "ls")
    assert sorted(lines) == ["b.txt", "c.bin", "d/a.txt"] and said.strip().endswith("3 sources")
    # the work list goes through two processors, whose facts are merged, and is imported
    work, _ = _cli(capsys, *db, "worklist")
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join([*work, "", "{bad", json.dumps({"source_id": 9, "path": "/nowhere", "basis_rev": 0})])))
    hashed, said = _cli(capsys, *db, "process", "--fact", "hash.sha256", "--", "sh", "-c", "sha256sum {} | cut -c1-64 | grep -v ^$")
    assert len(hashed) == 3 and "/nowhere" in said
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(hashed)))
    both, _ = _cli(capsys, *db, "process", "--json", "--", "sh", "-c", "echo '{\"n\": 1.5, \"l\": [1, \"a\"], \"t\": \"x\\\\\"y\"}'")
    facts = [json.loads(x) for x in both]
    assert all(f["facts"]["n"] == 1.5 and f["facts"]["l"] == [1, "a"] and f["facts"]["t"] == 'x"y' and len(f["facts"]["hash.sha256"]) == 64 and f["path"].startswith(src) for f in facts)
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(both)))
    _cli(capsys, *db, "import-facts", "-")
    table, _ = _cli(capsys, *db, "facts")
    assert table[0].split() == ["key", "cnt", "pct", "builtin"] and any(x.startswith("content.n ") for x in table) and not any("source.inode" in x for x in table)
    assert any("source.inode" in x for x in _cli(capsys, *db, "facts", "--all")[0])
    assert "excluded" not in _cli(capsys, *db, "coverage")[0][0] and "excluded" in _cli(capsys, *db, "coverage", "--include-excluded")[0][0]
    _cli(capsys, *db, "cluster", "--where", "source.size > 0", "--dest", dst, "--pattern", "{stem}.{ext}", "-o", str(tmp_path / "m.toml"))
    _cli(capsys, *db, "apply", str(tmp_path / "m.toml"), "--dry-run")
    lines, said = _cli(capsys, *db, "ls", "--unarchived")
    assert len(lines) == 3


def test_records_keep_earlier_facts(spark):
    lines = spark.createDataFrame([('{"source_id":1,"path":"p q","basis_rev":2,"facts":{"a":1,"b":"x","c":null}}',), ('{"source_id":2,"path":"r","basis_rev":0}',), ("[]",), ("",)], "line string")
    out, errors = enrich.processed(lines, ["printf", "b=%s\nd=2\n", "{}"], "kv", now=5)
    assert [json.loads(r["line"]) for r in out.collect()] == [{"source_id": 1, "path": "p q", "basis_rev": 2, "observed_at": 5, "facts": {"a": 1, "b": "p q", "c": None, "d": "2"}}, {"source_id": 2, "path": "r", "basis_rev": 0, "observed_at": 5, "facts": {"b": "r", "d": "2"}}]
    assert errors.collect() == []
    assert [r["error"] for r in enrich.processed(lines, ["true"], "kv")[1].collect()] == ["no facts", "no facts"]


def test_entry_without_corpus_operators(tmp_path):
    """With both folders and the pipeline gone, the rest imports and its queries are there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    home = Path(__file__).resolve().parent.parent
    shutil.copytree(home / "cairnlake", tmp_path / "cairnlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    told = "import __spark_entry__ as e; q = e.queries(); assert 'worklist_basic' in q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q); print(len(q))"
    got = subprocess.run([sys.executable, "-B", "-c", told], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert got.returncode == 0 and int(got.stdout.split()[-1]) >= 80, got.stderr
