"""The public calls and the command line, end to end."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lamplight import cli, schemas
from lamplight.service import Service
from lamplight.settings import Settings
from lamplight.sources.warehouse import Warehouse


@pytest.fixture
def service(spark, tmp_path):
    return Service(Warehouse(spark, f"{tmp_path}/store", Settings(report_buckets=2)), extractor=cli.PlainText())


def command(service, *argv):
    return cli.run(service, cli.parser().parse_args(["--root", service.store.root, *argv]))


def test_walkthrough(service, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.pdf").write_text("%PDF-1.7\nHeading one\nThe harbour opens at dawn every day.\n")
    (folder / "two.pdf").write_text("%PDF-1.7\nHeading two\nNothing about boats is said here.\n")
    (folder / "bad.pdf").write_text("x")
    assert command(service, "channels", "create", " News ", "--meta", "k=v") == 0
    channel = capsys.readouterr().out.strip()
    assert service.channel_named("News").first()["id"] == channel
    with pytest.raises(FileExistsError):
        service.create_channel("News")
    with pytest.raises(ValueError):
        service.create_channel("  ")
    assert command(service, "ingest", str(folder), "--channel-id", channel.upper()) == 1
    assert "succeeded 2 / 3" in capsys.readouterr().out
    command(service, "query", "harbour dawn", "--channel-id", channel, "--top-k", "1", "--neighbours", "0")
    assert "harbour opens" in capsys.readouterr().out
    command(service, "query", "harbour dawn", "--channel-id", channel, "--json", "--no-rerank")
    assert '"primary_rank":1' in capsys.readouterr().out
    command(service, "channels", "show", channel)
    assert "two.pdf" in capsys.readouterr().out
    rows = {r["filename"]: r for r in service.reports(channel).collect()}
    assert rows["one.pdf"]["chunk_count"] == 1 and rows["one.pdf"]["title"] == "one"
    assert service.delete_report(rows["one.pdf"]["report_id"]) == 1
    assert [r["filename"] for r in service.reports(channel).collect()] == ["two.pdf"]
    assert service.delete_report(rows["two.pdf"]["report_id"]) == 1
    assert service.reports(channel).count() == 0
    with pytest.raises(LookupError):
        service.delete_report("nope")


def test_upsert_keeps_the_id(service):
    first = service.upsert_report("c", " a.pdf ", "one")
    assert service.upsert_report("c", "a.pdf", "two") == first
    assert service.report(first).first()["title"] == "two"


def test_login_and_link(service, spark):
    digest = hashlib.sha256(b"secret").hexdigest()
    service.store.overwrite("tenants", spark.createDataFrame([(1, "A", None, {}, [])], schemas.TENANTS))
    service.store.overwrite("users", spark.createDataFrame([(7, "N", "n", digest, 1, [], {})], schemas.USERS))
    service.link_tenant(1, "corpus")
    with pytest.raises(FileExistsError):
        service.link_tenant(1, "other")
    with pytest.raises(LookupError):
        service.link_tenant(5, "other")
    assert service.login("n", "wrong") is None
    profile, session = service.login("n", digest, "10.0.0.1")
    assert profile.first()["rag_channel_id"] == "corpus"
    service.logout(session)
    assert service.store.read("sessions").first()["ended_at"] is not None


def test_migrate(service, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "001.sql").write_text("SELECT 1;\nSELECT 2;\n")
    assert service.migrate(f"{tmp_path}/m", dry_run=True) == ["001.sql"]
    assert service.migrate(f"{tmp_path}/m") == ["001.sql"]
    assert service.migrate(f"{tmp_path}/m") == []


def test_settings_from_environment():
    got = Settings.from_env({"SESSION_HOURS": "3", "BUCKET": "b", "OCR_MIN_CONFIDENCE": "0.7", "OTHER": "x"})
    assert (got.session_hours, got.bucket, got.ocr_min_confidence) == (3, "b", 0.7)


def test_ingest_moves_no_vectors_and_keeps_other_reports(spark, tmp_path, monkeypatch):
    """Chunks are dealt out before they are embedded, and are written once; reports beside them in a folder stay."""
    from lamplight import session
    from lamplight.functions.providers import LexicalEmbedder
    from lamplight.plans import ingest as plan
    from lamplight.sources import extract, warehouse

    written = []
    monkeypatch.setattr(warehouse, "stored", lambda df, name="stage": written.append(df.columns) or session.stored(df, name))
    store = warehouse.Warehouse(spark, str(tmp_path / "store"), Settings(report_buckets=1))

    def ingest(names):
        rows = [(n, "c", f"{n}.txt", "", {}, f"Title of {n}\nA line of {n}, the {i}th.") for i, n in enumerate(names)]
        docs = spark.createDataFrame(rows, "seq string, channel_id string, filename string, title string, metadata map<string,string>, text string")
        plan.ingest_documents(store, docs, extract.text_items(F.col("text")), LexicalEmbedder(), "plain-text")

    ingest(["a", "b", "c"])
    ingest(["b", "d"])
    assert not any("embedding" in columns or "content" in columns for columns in written)
    got = sorted(r["content"] for r in store.read("report_chunks").collect())
    assert len(got) == 4 and [c.split()[2] for c in got] == ["a", "b", "c", "d"] and "the 0th" in got[1]
    assert all(len(r["embedding"]) == 64 for r in store.read("report_chunks").collect())
