"""sha256 of files: the same whether a file is one cell or is read split by split."""

import gzip
import hashlib
import random

import pytest

from sondeo.sources import chain, sinks

LONG = 9 << 20      # three splits of 4 MB at the least


def noise(n):
    return random.Random(n).randbytes(n)


FILES = {
    "noise.parquet": noise(LONG),
    "ends in a line.bin": noise(LONG) + b"\n\n",
    "a [1]{b}*?,c.bin": noise(LONG + 1),
    "last block is full.bin": noise(LONG - 2) + b"\r\x00",
    "one short of full.bin": noise(LONG - 2) + b"\xff",
    "mark.csv": b"\xef\xbb\xbf" + noise(LONG),
    "no line.bin": noise(LONG).replace(b"\n", b"\r"),
    "lines.bin": b"\n" * (1 << 20) + b"\n",
    "one cell.bin": noise(1 << 20),
    "short.bin": b"x\n",
}


def facts(spark, folder):
    return sorted((r.path.rsplit("/", 1)[1], r.length, r.sha256) for r in sinks.file_fingerprints(spark, str(folder)).collect())


def truth(files):
    return sorted((name, len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items())


@pytest.fixture
def narrow(spark, monkeypatch):
    """Cells of files hold 1 MB at most, as they hold 2 GB otherwise."""
    monkeypatch.setattr(sinks, "WHOLE", 1 << 20, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(1 << 20))
    yield
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_files_longer_than_a_cell_are_hashed_whole(spark, tmp_path, narrow):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    assert facts(spark, tmp_path) == truth(FILES)


def test_no_task_reads_a_long_file_whole(spark, tmp_path):
    (tmp_path / "noise.bin").write_bytes(FILES["noise.parquet"])
    read = chain._pieces(spark, str(tmp_path / "noise.bin")).rdd.mapPartitions(lambda pieces: [sum(len(p.piece) for p in pieces)]).collect()
    assert len(read) == 3 and max(read) < LONG / 2 and sum(read) - LONG in (0, 1)


def test_packed_files_are_hashed_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "WHOLE", 1 << 20)
    files = {"long [1].gz": gzip.compress(noise(2 << 20)), "short.gz": gzip.compress(b"x"), "noise.bin": noise(2 << 20)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    assert facts(spark, tmp_path) == truth(files)


def test_without_a_hash_that_resumes_a_file_is_a_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "WHOLE", 10)
    monkeypatch.setattr(chain, "_openssl", lambda: None)
    (tmp_path / "x.bin").write_bytes(b"a\nb" * 10)
    assert facts(spark, tmp_path) == truth({"x.bin": b"a\nb" * 10})


def test_other_bytes_than_a_file_has_are_refused(spark, tmp_path):
    path = tmp_path / "x.bin"
    path.write_bytes(b"a\nb\n")
    with pytest.raises(RuntimeError, match="not read byte for byte"):
        chain.long_file_sha256(spark, {f"file:{path}": 9})


@pytest.mark.parametrize("n", [1, 54, 55, 56, 63, 64, 65, 119, 120, 127, 128, 129, 1000])
@pytest.mark.parametrize("ended", [True, False])
def test_a_hash_handed_on_is_the_hash(n, ended):
    data, cuts = noise(n), random.Random(n)
    state, at, fed = chain.start(), 0, data if ended else data + b"\n"
    while at < len(fed):
        step = cuts.randint(0, 70)
        state, at = chain.add(state, fed[at:at + step]), at + step
    assert chain.digest(state, n) == hashlib.sha256(data).hexdigest()
    assert chain.digest(state, n + 5) is None
    with pytest.raises(RuntimeError, match="came after"):
        chain.add(chain.add(state, b"", 4), b"", 3)
