import hashlib
import json
import subprocess
import sys

import pytest

from quillspark.plans.analysis import corpus_analysis
from quillspark.sources import io
from quillspark.streaming.requirements import stream_candidates, write_once


def test_sources_are_checked(spark, tmp_path):
    good = [{"id": "a", "title": "A", "topic": "t", "url": "https://x.test/docs/1"}]
    path = tmp_path / "sources.json"

    def read(rows):
        path.write_text(json.dumps(rows), encoding="utf-8")
        return io.read_sources(spark, str(path), "x.test", "/docs/").collect()

    assert len(read(good)) == 1
    for bad in ([], good + good, [{**good[0], "url": "http://x.test/docs/1"}], [{**good[0], "url": "https://y.test/docs/1"}], [{**good[0], "title": ""}]):
        with pytest.raises(Exception):
            read(bad)


def test_documents_from_snapshots(spark, tmp_path):
    text = "слово " * 1100
    page = f'<div class="text_upd"><article><p>Статья 1. Тест</p><p>{text}</p><p>Сноска. нет</p></article></div>'.encode()
    (tmp_path / "a.html").write_bytes(page)
    meta = {"url": "https://x.test/1", "fetched_at_utc": "2026-01-01T00:00:00+00:00", "sha256": hashlib.sha256(page).hexdigest()}
    (tmp_path / "a.meta.json").write_text(json.dumps(meta))
    sources = spark.createDataFrame([("a", "A", "t", "https://x.test/1"), ("b", "B", "t", "https://x.test/2")], io.SOURCES)
    pages, metas = io.read_snapshots(spark, str(tmp_path))
    got = io.build_documents(sources, pages, metas).collect()
    assert len(got) == 1 and got[0].word_count == 1102 and "Сноска" not in got[0].text
    assert [r.id for r in io.missing_snapshots(sources, pages).collect()] == ["b"]
    (tmp_path / "a.meta.json").write_text(json.dumps(meta | {"sha256": "0"}))
    pages, metas = io.read_snapshots(spark, str(tmp_path))
    with pytest.raises(Exception, match="checksum"):
        io.build_documents(sources, pages, metas).collect()


def test_files(spark, tmp_path):
    (tmp_path / "bom.csv").write_text('﻿term,score\n"a, b",1.5\n', encoding="utf-8")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "bom.csv"), "term string, score double").collect()] == [("a, b", 1.5)]
    df = spark.createDataFrame([("я", 1)], "term string, n int")
    io.write_csv(df, str(tmp_path / "c"), ["n", "term"])
    assert io.read_csv(spark, str(tmp_path / "c"), "n int, term string").first().term == "я"
    with pytest.raises(ValueError):
        io.write_csv(df.limit(0), str(tmp_path / "e"), allow_empty=False)
    io.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.schema("term string").json(str(tmp_path / "j")).first().term == "я"
    io.write_matrix(df, str(tmp_path / "m"))
    assert io.read_matrix(spark, str(tmp_path / "m")).count() == 1
    assert io.read_control_examples(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "p.jsonl").write_text('{"article_id": "a", "clean_word_count": 3}\n\n{"article_id": "b", "clean_word_count": 30}\n')
    assert io.read_processed(spark, str(tmp_path / "p.jsonl"), 20).count() == 1
    with pytest.raises(ValueError):
        io.read_processed(spark, str(tmp_path / "p.jsonl"), 99)
    (tmp_path / "bad.json").write_text('{"other": "data"}')
    with pytest.raises(Exception, match="articles"):
        io.read_analysis(spark, str(tmp_path / "bad.json")).collect()


ACT = "Тест\nСтатья 1. Первая\nОператор обязан хранить данные.\nСтатья 2. Вторая\nЭто описание."


def test_command_line(tmp_path):
    (tmp_path / "act.txt").write_text(ACT, encoding="utf-8")
    run = lambda *a: subprocess.run([sys.executable, "-m", "quillspark", *a], capture_output=True, text=True, timeout=180)
    direct = run(str(tmp_path / "act.txt"), "--format", "md")
    assert direct.returncode == 0 and "## Статья 1. Первая" in direct.stdout
    assert run(str(tmp_path / "act.txt"), "--output", str(tmp_path / "a.json")).returncode == 0
    assert run(str(tmp_path / "a.json")).stdout == direct.stdout
    assert run(str(tmp_path / "none.txt")).returncode == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(ACT, encoding="utf-8")
    go = lambda: write_once(stream_candidates(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert go()
    assert go()
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.article_number, r.markers) for r in rows] == [("1", ["обязан"])]


def test_corpus_analysis(spark):
    body = "данные субъекта защищает оператор связи всегда и везде без исключений по закону"
    docs = spark.createDataFrame([("a", "A", f"Статья 1. Х\n{body}\nСтатья 2. У\n{body} риск"), ("b", "B", f"Статья 1. Х\n{body} модель риск риск")], "id string, title string, text string")
    out = corpus_analysis(docs)
    assert out["summary"].first().articles == 3
    assert [r.term for r in out["vocabulary"].orderBy("feature_index").collect()] == ["риск"]  # found in 2 of 3, others in all
    assert out["top50_words"].first().frequency == 3 and out["top50_tfidf"].count() == 1
