import os

import pytest

from loomtrace.streaming import appended, intake


def lines_of(spark, out):
    return sorted((os.path.basename(r.path), r.byte, r.text) for r in spark.read.parquet(out).collect())


@pytest.fixture
def capture(spark, tmp_path):
    """Run the stream once over a folder of logs; give all that has come so far."""
    logs, out, state = tmp_path / "logs" / "H1", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir(parents=True)

    def run(piece_bytes=appended.PIECE_BYTES):
        intake.run_once(appended.appended_lines(spark, str(tmp_path / "logs"), piece_bytes=piece_bytes), out, state)
        return lines_of(spark, out)

    return logs, run


def test_appended_bytes_come_once(capture):
    logs, run = capture
    (logs / "audit.log").write_text("one\ntwo\nunfin")
    (logs / "_hidden").write_text("no\n")
    assert run() == [("audit.log", 0, "one"), ("audit.log", 4, "two")]
    with open(logs / "audit.log", "a") as file:
        file.write("ished\nthree\n")
    (logs / "syslog").write_bytes(b"\xff ok\r\n\nlast")
    want = [("audit.log", 0, "one"), ("audit.log", 4, "two"), ("audit.log", 8, "unfinished"), ("audit.log", 19, "three"), ("syslog", 0, "� ok"), ("syslog", 6, "")]
    assert run() == want
    # a restart without news reads nothing again
    assert run() == want


def test_files_begun_anew_are_read_from_the_start(capture):
    logs, run = capture
    for name in ("short", "long"):
        (logs / name).write_text("old 1\nold 2\n")
    assert len(run()) == 4
    (logs / "short").write_text("new\n")
    (logs / "long").write_text("new 1\nnew 2\nnew 3\n")
    assert [r for r in run() if r[2].startswith("new")] == [("long", 0, "new 1"), ("long", 6, "new 2"), ("long", 12, "new 3"), ("short", 0, "new")]


@pytest.mark.parametrize("piece_bytes", [1, 3, 7, 64])
def test_pieces_hold_each_line_once(capture, piece_bytes):
    logs, run = capture
    texts = ["", "a", "longer than a piece of seven bytes", "é", "", "end"]
    (logs / "x.log").write_text("\n".join(texts) + "\n")
    assert [r[2] for r in run(piece_bytes)] == texts
    with open(logs / "x.log", "a") as file:
        file.write("more\nand more\n")
    assert [r[2] for r in run(piece_bytes)] == [*texts, "more", "and more"]


def test_whole_lines_and_paths(tmp_path, monkeypatch):
    monkeypatch.setattr(appended, "_STEP", 4)
    path = tmp_path / "f"
    path.write_bytes(b"ab\ncd\n" + b"x" * 50)
    assert [appended.whole_lines(str(path), n) for n in (0, 2, 3, 5, 6, 56)] == [0, 0, 3, 3, 6, 6]
    assert appended.local_path("file:///a/b") == "/a/b" == appended.local_path("file:/a/b") == appended.local_path("/a/b")
    with pytest.raises(ValueError, match="hdfs"):
        appended.local_path("hdfs://x/a")


def test_small_pieces_share_a_task(tmp_path, monkeypatch):
    """Tasks grow with the bytes, not with the pieces; every line still comes once."""
    monkeypatch.setattr(appended, "LEAST_TASKS", 4)
    texts = [f"line {i}" for i in range(300)]
    (tmp_path / "x.log").write_text("\n".join(texts) + "\n")
    reader = appended.Appended(str(tmp_path), 5)
    end = reader.latestOffset()
    tasks = reader.partitions({}, end)
    assert 4 <= len(tasks) <= 8 and len(reader.pieces({}, end)) > 400
    assert [t for p in tasks for b in reader.read(p) for t in b.column("text").to_pylist()] == texts
    monkeypatch.setattr(appended, "TASK_BYTES", 50)
    assert all(len(p.pieces) <= 10 for p in reader.partitions({}, end))
