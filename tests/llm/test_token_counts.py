import unicodedata

import numpy as np
import pytest

from loamstone.llm import token_counts
from loamstone.llm.queries import END_OF_DOCUMENT, RANKS_PATH, op7_token_counts
from tests.llm.helpers import docs, random_texts


def brute(stream, end):
    out, n = [], 0
    for t in stream:
        if t == end:
            out.append((len(out), n, True))
            n = 0
        else:
            n += 1
    return out + ([(len(out), n, False)] if n else [])


@pytest.mark.parametrize(("block", "group"), [(1, 3), (4, 2), (7, 4096), (64, 4096)])
def test_separators_across_blocks_and_groups(spark, monkeypatch, block, group):
    monkeypatch.setattr(token_counts, "GROUP", group)
    r = np.random.default_rng(block)
    streams = [r.choice([9, 1, 2], size=n, p=[p, (1 - p) / 2, (1 - p) / 2]) for n, p in ((0, 0.5), (50, 0.1), (60, 0.6), (40, 0.0), (33, 1.0), (200, 0.01))]
    rows = [(s, k // block, t[k : k + block].astype("<u2").tobytes()) for s, t in enumerate(streams) for k in range(0, len(t), block)]
    blocks = spark.createDataFrame(rows, "stream int, block long, tokens binary")
    got = token_counts.document_lengths(token_counts.separators(blocks, 9)).collect()
    for s, t in enumerate(streams):
        assert sorted((x.place, x.n_tokens, x.closed) for x in got if x.stream == s) == brute(t, 9)


def test_flat_files(spark, tmp_path):
    r = np.random.default_rng(0)
    tokens = {f"{k}.bin": r.integers(0, 20, 5000).astype("<u4") for k in range(3)}
    for name, t in tokens.items():
        t.tofile(tmp_path / name)
    blocks = token_counts.read_files(spark, str(tmp_path), width=4, block_tokens=64)
    got = token_counts.document_lengths(token_counts.separators(blocks, 0, width=4)).collect()
    for name, t in tokens.items():
        assert sorted((x.place, x.n_tokens, x.closed) for x in got if x.stream.endswith(name)) == brute(t, 0)


def test_one_file_is_many_tasks(spark, tmp_path):
    r = np.random.default_rng(1)
    t = r.integers(0, 50, 20_011).astype("<u2")
    t.tofile(tmp_path / "long.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    for block, ranges in ((1, 4096), (7, 64), (64, 16), (8192, 1), (1 << 20, 512)):
        blocks = token_counts.read_files(spark, [str(tmp_path / "long.bin"), str(tmp_path / "empty.bin")], block_tokens=block, range_blocks=ranges)
        want = -(-len(t) // (block * ranges))
        assert token_counts.file_ranges(spark, str(tmp_path), 2 * block * ranges).count() == want
        assert blocks.rdd.getNumPartitions() == min(want, 4 * spark.sparkContext.defaultParallelism)
        got = token_counts.document_lengths(token_counts.separators(blocks, 0)).collect()
        assert sorted((x.place, x.n_tokens, x.closed) for x in got) == brute(t, 0)


def test_ids_beyond_the_width(spark, tmp_path):
    one = docs(spark, [(1, "a b c")])
    with pytest.raises(Exception, match="does not fit into 1 bytes"):
        token_counts.write_files(one, str(tmp_path / "a"), RANKS_PATH, width=1).collect()
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number of tokens"):
        token_counts.read_files(spark, str(tmp_path / "odd.bin")).collect()


@pytest.mark.parametrize("width", [2, 4])
def test_documents_against_the_tokenizer(spark, tmp_path, width):
    rows = list(enumerate(random_texts(80, 5))) + [(90, None), (91, ""), (92, "<|endoftext|>"), (None, "x"), (93, "é " * 60_000), (92, "twice")]
    table = docs(spark, rows).repartition(3)
    with open(RANKS_PATH, "rb") as f:
        enc = token_counts.encoder(f.read())
    order = token_counts.write_files(table, str(tmp_path / "t"), RANKS_PATH, width=width).collect()
    blocks = token_counts.read_files(spark, str(tmp_path / "t"), width=width, block_tokens=256, range_blocks=4)
    lengths = token_counts.document_lengths(token_counts.separators(blocks, END_OF_DOCUMENT, width)).collect()
    by = {(r.stream.rpartition("/")[2], r.place): r.n_tokens for r in lengths}
    got = sorted(((r.doc_id, by[r.file.rpartition("/")[2], r.place]) for r in order), key=repr)
    assert got == sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in rows), key=repr)


def test_query(spark, tmp_path):
    for name, rows in (("some", [(1, "a b"), (2, None)]), ("none", [])):
        docs(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted(map(tuple, op7_token_counts(spark, f"{tmp_path}/{name}").collect()))
        assert got == ([(1, 2), (2, 0)] if rows else [])


def pieces(text):
    """PATTERN as a loop over the characters, so that no run is too long."""
    blank = set("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
    kind = lambda c: " " if c in blank else {"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "S")
    at, n = 0, len(text)
    kinds = [kind(c) for c in text]
    while at < n:
        first, end = at, at
        if kinds[at] == " ":
            while end < n and kinds[end] == " ":
                end += 1
            if end < n and end - at > 1:
                end -= 1
            elif end < n and text[at] == " ":  # one blank goes with what follows
                first = end
        if first == end:
            end = first + 1
            while end < n and kinds[end] == kinds[first]:
                end += 1
        yield text[at:end]
        at = end


RUNS = {"blank": " ", "line end": "\n", "wide": "\u3000", "letter": "a", "digit": "7", "sign": "!"}


def long_texts():
    for c in RUNS.values():
        yield from (c * 1_000_000, "x" + c * 60_000 + "y", c * 60_000 + " b", "b " + c * 60_000)
    yield " \n\t\u2003" * 250_000 + "end"
    yield "".join(c * 55_000 for c in RUNS.values()) * 3
    yield ("word" + " " * 50_001) * 3 + "\u2003" * 50_000 + "7"


def test_runs_of_any_length_give_the_ids_of_the_pieces():
    enc = token_counts.encoder(open(RANKS_PATH, "rb").read())
    for text in ["", " ", "a", " a", "a ", "  a b  ", "a\n\n b", "\u3000a", "1 2!? x"]:
        assert [i for p in pieces(text) for i in enc._encode_single_piece(p)] == enc.encode_ordinary(text)
    for text in long_texts():
        assert token_counts.encode(enc, text) == [i for p in pieces(text) for i in enc._encode_single_piece(p)]


def test_a_million_blanks_in_a_job(spark, tmp_path):
    rows = [(1, " " * 1_000_000), (2, "a" + "\n" * 1_000_000 + "b")]
    order = token_counts.write_files(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}", RANKS_PATH)
    assert order.count() == 2
    found = token_counts.separators(token_counts.read_files(spark, f"file://{tmp_path}"), 50256)
    assert sorted(r.n_tokens for r in token_counts.document_lengths(found).collect())[0] > 0
