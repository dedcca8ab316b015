"""Discovery, reconciliation and refresh from end to end, with transports that answer from a table of pages."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium.plans import runs
from scriptorium.plans.pipeline import Budget
from scriptorium.schemas import ENTRY
from scriptorium.sources import snapshots

NOW, LATER = "2026-03-01T00:00:00.000Z", "2026-03-02T12:00:00.000Z"
PAGES = {
    "https://github.com/lab/atlas": ("Atlas: Grounded Reasoning over Long Documents", "Large language model agents: \"Atlas: Grounded Reasoning over Long Documents\" is accepted to ACL 2026"),
    "https://github.com/lab/known": ("Known: Results of the Long Catalogue", "Large language model agents: \"Known: Results of the Long Catalogue\" is accepted to AAAI 2026"),
    "https://example.org/shop": ("Buy shoes", "Cheap shoes for all."),
    "https://x.com/someone/1": ("Borealis: Multimodal Agents with Memory", "Multimodal agents: \"Borealis: Multimodal Agents with Memory\" is accepted to ICLR 2026"),
}
PLANS = [("seed-1", '"accepted to" "ACL 2026"', "seed", "web", 1), ("seed-2", '"accepted to" "AAAI 2026"', "seed", "web", 2), ("social-1", "x multimodal 2026", "social", "x", 3)]
ANSWERS = {'"accepted to" "ACL 2026"': ["https://github.com/lab/atlas", "https://example.org/shop"], '"accepted to" "AAAI 2026"': ["https://github.com/lab/known"], "x multimodal 2026": ["https://x.com/someone/1"]}


def service(folder, verdict=None, broken=()):
    """A transport that leaves a file for each call."""
    folder.mkdir(exist_ok=True)

    def post(place, body):
        (folder / f"{place.replace('/', '-')}-{uuid.uuid4().hex}").touch()
        if place in broken:
            raise OSError("down")
        if place == "web_search":
            found = ANSWERS.get(body["search_query"], ["https://x.com/someone/1"] if body["search_query"].startswith('"Borealis') else [])
            return json.dumps({"search_result": [{"link": u, "title": PAGES[u][0], "content": PAGES[u][1]} for u in found]})
        if place == "reader":
            return json.dumps({"data": {"title": PAGES[body["url"]][0], "content": PAGES[body["url"]][1]}})
        return json.dumps({"choices": [{"message": {"content": "So: " + json.dumps(verdict)}}]})

    return post, lambda: {k: len(list(folder.glob(f"{k}-*"))) for k in ("web_search", "reader", "chat-completions")}


@pytest.fixture
def official(spark):
    return spark.createDataFrame([(1, "Known: Results of the Long Catalogue", "AAAI 2026", 2026)], "pos long, title string, venue string, year int")


@pytest.fixture
def plans(spark):
    rows = [(n, label, query, stage, platform, None, "oneMonth", "search_pro", "high", "", "") for label, query, stage, platform, n in PLANS]
    return spark.createDataFrame(rows, "pos long, label string, query string, stage string, platform string, domainFilter string, recencyFilter string, searchEngine string, contentSize string, intent string, parentUrl string")


def test_discovery(spark, tmp_path, official, plans):
    """A run that fails at its reader is started again: searches aren't made twice; then what is found is in the queue, and another run updates it."""
    store, folder = f"{tmp_path}/store", f"{tmp_path}/run"
    down, made = service(tmp_path / "calls", broken=("reader",))
    from scriptorium.sources import journal

    with pytest.raises(journal.CallsFailed):
        runs.discover(spark, folder, store, official, down, NOW, queries=8, follow_ups=3, plans=plans)
    searched = made()["web_search"]
    assert searched >= 3 and snapshots.version(spark, store) == 0
    up, made = service(tmp_path / "calls")
    trace = runs.discover(spark, folder, store, official, up, NOW, queries=8, follow_ups=3, plans=plans)
    assert made()["web_search"] == searched == trace["searchQueriesRun"]
    entries = {r["title"]: r for r in snapshots.read_snapshot(spark, store, ENTRY).collect()}
    assert "Atlas: Grounded Reasoning over Long Documents" in entries and not any("Known" in t or "shoes" in t for t in entries)
    atlas = entries["Atlas: Grounded Reasoning over Long Documents"]
    assert atlas["acceptedVenue"].startswith("ACL 2026") and atlas["status"] == "accepted" and atlas["enrichmentStatus"] == "provisional" and atlas["evidence"][0]["readerExcerpt"]
    assert trace["added"] == len(entries) and trace["updated"] == 0 and trace["rejectedCandidates"] >= 1 and trace["version"] == 1
    assert json.loads((tmp_path / "run" / "trace.json").read_text()) == trace
    again = runs.discover(spark, folder, store, official, up, LATER, queries=8, follow_ups=3, plans=plans)  # all tables are there: nothing is called, nothing changes
    assert made()["web_search"] == searched and again["partsWritten"] == 0 and again["version"] == 2


def entry(**own):
    return tuple(own.get(f.name) for f in ENTRY)


def test_reconciliation(spark, tmp_path, official):
    store = f"{tmp_path}/store"
    rows = [
        entry(id="k", title="Known: Results of the Long Catalogue", status="candidate", confidence=0.5, lastCheckedAt=NOW), entry(id="b", title="Borealis: Multimodal Agents with Memory", status="candidate", confidence=0.4, lastCheckedAt=NOW, authors=["A. One"], reason="seen", evidence=[("x", "https://x.com/someone/1", "t", None, "s", None, None, None, "q")]),
        entry(id="f", title="Fresh: Checked an Hour Ago", status="candidate", confidence=0.4, lastCheckedAt="2026-03-02T11:00:00.000Z"), entry(id="a", title="Accepted: Before", status="accepted", acceptedVenue="ACL 2026", confidence=0.9),
    ]
    snapshots.write_snapshot(spark.createDataFrame(rows, ENTRY), store, "id")
    verdict = {"accepted": True, "acceptedVenue": "ICLR 2026", "acceptedYear": 2026, "confidence": 0.8, "reason": "announced", "acceptanceEvidence": {"url": "", "title": "", "venue": "", "snippet": "said so"}}
    post, made = service(tmp_path / "calls", verdict)
    said = runs.reconcile(spark, f"{tmp_path}/run", store, official, post, LATER)
    assert said["published"] == 1 and said["promoted"] == 1 and said["checked"] == 1 and said["entries"] == 4 and said["version"] == 2
    assert made() == {"web_search": 1, "reader": 1, "chat-completions": 1}
    out = {r["id"]: r for r in snapshots.read_snapshot(spark, store, ENTRY).collect()}
    assert out["k"]["status"] == "officially-published" and out["k"]["confidence"] == 1.0
    b = out["b"]
    assert b["status"] == "accepted" and b["acceptedVenue"] == "ICLR 2026" and b["confidence"] == 0.8 and b["reason"] == "announced" and b["acceptanceEvidence"]["snippet"] == "said so" and b["acceptanceEvidence"]["url"] == "https://x.com/someone/1"
    assert len(b["evidence"]) == 1 and b["evidence"][0]["readerExcerpt"] and b["lastCheckedAt"] == LATER
    assert out["f"]["lastCheckedAt"] == "2026-03-02T11:00:00.000Z" and out["a"]["status"] == "accepted"
    none = runs.reconcile(spark, f"{tmp_path}/run2", store, official, post, LATER)
    assert none["checked"] == 0 and none["version"] == 3 and none["partsWritten"] == 0


def test_refresh():
    done = []
    steps = {n: (lambda n=n: done.append(n)) for n in ("discover", "reconcile", "ingest", "shards", "sync-data", "embeddings", "sync-vectors", "validate")}
    assert [s for _, s, _ in runs.refresh(steps)] == ["ok"] * 6 and done == ["ingest", "shards", "sync-data", "embeddings", "sync-vectors", "validate"]
    done.clear()
    log = runs.refresh(steps | {"shards": lambda: 1 / 0}, with_discovery=True)
    assert [(n, s) for n, s, _ in log][:4] == [("discover", "ok"), ("reconcile", "ok"), ("ingest", "ok"), ("shards", "failed")] and {s for _, s, _ in log[4:]} == {"skipped"} and done == ["discover", "reconcile", "ingest"]
    with pytest.raises(ValueError, match="no step for validate"):
        runs.refresh({k: v for k, v in steps.items() if k != "validate"})
