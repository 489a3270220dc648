"""Files that grow, are cut in parts and are replaced: every complete line comes once."""

import random

import pytest

from trafficlens.streaming import tail as T
from trafficlens.streaming.run import drain


def batch(reader, start, end):
    rows = []
    for part in reader.partitions(start, end):
        for found in reader.read(part):
            rows += [(r["src_file"].rpartition("/")[2], r["line_no"], r["value"]) for r in found.to_pylist()]
    return rows


@pytest.mark.parametrize("part", [7, 100, 1 << 20])
def test_lines_come_once_however_files_grow(tmp_path, part):
    draw = random.Random(part)
    reader = T.TailReader({"path": str(tmp_path), "start": "begin", "partbytes": part})
    at, got, want, text = reader.initialOffset(), [], [], {"a": b"", "b": b""}
    for step in range(12):
        for name in text:
            line = bytes(draw.choice(b"xyz \xff\xc3") for _ in range(draw.choice([0, 1, 30, 200])))
            text[name] += line + draw.choice([b"\n", b"\r\n", b""])
            (tmp_path / name).write_bytes(text[name])
        (tmp_path / "_hidden").write_text("no\n")
        end = reader.latestOffset()
        got += batch(reader, at, end)
        at = end
    for name, whole in text.items():
        place = 0
        for line in whole.split(b"\n")[:-1]:
            want.append((name, place, line.removesuffix(b"\r").decode(errors="replace")))
            place += len(line) + 1
    assert sorted(got) == sorted(want)
    assert batch(reader, at, reader.latestOffset()) == []


def test_replaced_and_cut_files_start_again(tmp_path):
    path = tmp_path / "access.log"
    path.write_text("one\ntwo\n")
    reader = T.TailReader({"path": str(tmp_path / "access.*")})
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert batch(reader, start, first) == []  # what is there at the start is passed over
    path.write_text("one\ntwo\nthree\nfo")
    second = reader.latestOffset()
    assert [v for *_, v in batch(reader, first, second)] == ["three"]
    path.write_text("new\nfour\nfive\nsix\nseven\n")
    third = reader.latestOffset()
    assert [v for *_, v in batch(reader, second, third)] == ["new", "four", "five", "six", "seven"]
    path.write_text("new\n")  # cut short, the same first line
    fourth = reader.latestOffset()
    assert [v for *_, v in batch(reader, third, fourth)] == ["new"]
    (tmp_path / "access.1").write_text("y" * 200_000 + "\nz\n")
    assert [len(v) for *_, v in batch(reader, fourth, reader.latestOffset())] == [200_000, 1]
    assert T.TailReader({"path": str(tmp_path / "none")}).latestOffset() == {"files": "{}"}


def test_a_stopped_stream_goes_on(spark, tmp_path):
    path, base = tmp_path / "log", str(tmp_path / "base")
    lines = [f"line {i}" for i in range(300)]
    path.write_text("\n".join(lines[:100]) + "\n")
    run = lambda: sorted(r.value for r in drain(T.tail_log_lines(spark, str(path), part_bytes=64), base).collect())
    assert run() == []
    path.write_text("\n".join(lines[:250]) + "\n")
    assert run() == sorted(lines[100:250])
    path.write_text("\n".join(lines) + "\nopen")
    assert run() == sorted(lines[100:]) == run()
