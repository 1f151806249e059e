"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Texts are cut into pieces by the tokenizer's pattern. The pieces that a worker hasn't met are encoded by
one recursive query: token-position rows join the merge table on (token, next token), each piece's
leftmost pair of least rank is contracted, until no piece has a pair. Pieces of more than ``SHORT`` bytes, which would
take a step for each pair, contract in a step all pairs that no lesser pair can reach: a token that began with a
lesser pair would have to span what lies between, so pairs are compared within twice the length of the longest token
of the piece's bytes; of runs of equal pairs that overlap every second one is taken from the run's start. That gives the same
ids where every token of the ranks file encodes to itself, which a worker checks when it meets its first long piece;
for other files long pieces contract one pair a step, too. Decoding joins the ids with the
vocabulary and concatenates in the order of positions. There is no shuffle; the merge table and
the vocabulary are built in each worker from the ranks file, and a worker's memory is bounded by the slice of
a batch, the longest text and a cache of ``CACHE`` pieces, which is emptied when full.

Defined results: a null text is an empty one with no ids; a piece that is itself a token gets that id;
repeated rows and empty tables pass through; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, pieces, table, texts, trim

CACHE, CHUNK_ROWS, DECODE_IDS = 900_000, 500_000, 250_000
SHORT = 255  # pieces of up to so many bytes contract one pair a step
ROUNDS = 32  # steps of a long piece that one query keeps

_CONTRACT = """
with recursive step(k, w, p, e, t) as (
  select 0, w, p, e, t from seed
  union all
  select s.k + 1, s.w, s.p, case when s.p = b.p then b.e else s.e end, case when s.p = b.p then b.m else s.t end
  from step s join (
    select w, {unpack} from (
      select x.w, min({pack}) as z from step x join step y on x.w = y.w and x.e = y.p join merges m on x.t = m.a and y.t = m.b group by x.w)) b
  on s.w = b.w and s.p <> b.mid
),
ends as (select w, max(k) as k from step group by w)
select w, list(t order by p) as ids from step join ends using (w, k) group by w
"""
# The choice of a step is one number: rank, and places of up to SHORT + 1.
_PACKED = _CONTRACT.format(
    pack="(m.m::bigint << 40) + (x.p::bigint << 28) + (y.p::bigint << 14) + y.e",
    unpack="(z >> 40)::integer as m, ((z >> 28) & 4095)::integer as p, ((z >> 14) & 4095)::integer as mid, (z & 4095)::integer as e",
)
_FAR = """
with recursive step(k, w, p, e, t) as (
  select 0, w, p, e, t from seed
  union all
  select k + 1, w, p, case when c then e2 else e end, case when c then r else t end from (
    select *, lag(c, 1, false) over o as gone, bool_or(c) over (partition by w) as moved from (
      select *, coalesce((row_number() over u) % 2 = 1 and first_value(below >= r) over u and above >= r, false) as c from (
        select *, sum(case when r = before then 0 else 1 end) over o as run from (
          select *, lag(r) over o as before,
            min(r) over (partition by w order by p range between {reach} preceding and current row) as below,
            min(r) over (partition by w order by p range between current row and {reach} following) as above
          from (
            select x.*, m.m as r from (select *, lead(t) over o as t2, lead(e) over o as e2 from step window o as (partition by w order by p)) x
            left join merges m on x.t = m.a and x.t2 = m.b)
          window o as (partition by w order by p))
        window o as (partition by w order by p))
      window u as (partition by w, run order by p))
    window o as (partition by w order by p))
  where moved and not gone and k < {rounds}
),
ends as (select w, max(k) as k from step group by w)
select k, w, p, e, t from step join ends using (w, k)
"""
_WIDE = _CONTRACT.format(pack="(m.m, x.p, y.p, y.e)", unpack="z[1] as m, z[2] as p, z[3] as mid, z[4] as e")
_DECODE = "select d, string_agg(s, '' order by i) as text from encoded join vocabulary using (id) group by d"


@cache
def _codec(path: str, pattern: str):
    return Codec(path, pattern)


@cache
def _decoder(path: str):
    return Decoder(path)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _released(batches, *caches):
    """Passes batches on; at the end drops what the worker keeps for the next task, where its memory is needed for other stages."""
    yield from batches
    for c in caches:
        c.cache_clear()
    trim()


class Worker:
    """A worker's DuckDB connection."""

    def __init__(self) -> None:
        import duckdb

        # What exceeds the memory limit is spilled where Spark itself spills, not into the working folder.
        local = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
        config = {"threads": 1, "memory_limit": "250MB", "preserve_insertion_order": "false", "temp_directory": os.path.join(local, f"duckdb-{os.getpid()}")}
        self.db = duckdb.connect(config=config)

    def _put(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")


class Codec(Worker):
    """Merge table, and a cache of encoded pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        super().__init__()
        self.ranks = _ranks(path)
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        halves = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        self._put("merges", dict(zip("abm", (pa.array(x, pa.int32()) for x in zip(*halves, strict=True)), strict=True)))

    def learn(self, words) -> None:
        """Encodes pieces into the cache, as bytes of their ids (little-endian, 32 bits each)."""
        short: list[tuple[str, bytes]] = []
        wide: list[tuple[str, bytes]] = []
        rows = 0
        for w in words:
            raw = w.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[w] = whole.to_bytes(4, "little")
                continue
            if len(raw) > SHORT:
                wide.append((w, raw))
                continue
            short.append((w, raw))
            rows += len(raw)
            if rows >= CHUNK_ROWS:
                self._contract(short, _PACKED)
                short, rows = [], 0
        if short:
            self._contract(short, _PACKED)
        while wide:
            taken, rows = [], 0
            while wide and (not taken or rows + len(wide[-1][1]) <= CHUNK_ROWS):
                taken.append(wide.pop())
                rows += len(taken[-1][1])
            self._contract_far(taken) if self.consistent else self._contract(taken, _WIDE)

    def _seed(self, raws: list[bytes]) -> None:
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        flat = np.frombuffer(b"".join(raws), np.uint8)
        w = np.repeat(np.arange(len(raws), dtype=np.int32), n)
        p = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        self._put("seed", {"w": w, "p": p, "e": p + 1, "t": self.byte[flat]})

    def _contracted(self, raws: list[bytes], query: str):
        """(place in ``raws``, bytes of its ids)."""
        self._seed(raws)
        got = self.db.sql(query).to_arrow_table().combine_chunks()
        at, ids = got.column(0).to_pylist(), got.column(1).chunk(0)
        cuts = ids.offsets.to_numpy() * 4
        data = ids.values.to_numpy().astype("<u4").tobytes()
        return ((k, data[a:b]) for k, a, b in zip(at, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def _contract(self, todo: list[tuple[str, bytes]], query: str) -> None:
        for k, ids in self._contracted([raw for _, raw in todo], query):
            self.cache[todo[k][0]] = ids

    def _contract_far(self, todo: list[tuple[str, bytes]]) -> None:
        self._seed([raw for _, raw in todo])
        used = frozenset(b"".join(raw for _, raw in todo))
        query = _FAR.format(reach=2 * max(len(t) for t in self.ranks if used.issuperset(t)), rounds=ROUNDS)
        while True:
            # A query keeps the rows of its steps; the last ones begin the next query, until none moves.
            got = self.db.sql(query).to_arrow_table()
            self._put("seed", {c: got.column(c) for c in ("w", "p", "e", "t")})
            if pc.max(got.column("k")).as_py() < ROUNDS:
                break
        got = got.sort_by([("w", "ascending"), ("p", "ascending")])
        w, t = got.column("w").to_numpy(), got.column("t").to_numpy().astype("<u4")
        cuts = np.searchsorted(w, np.arange(len(todo) + 1))
        for (word, _), a, b in zip(todo, cuts[:-1], cuts[1:], strict=True):
            self.cache[word] = t[a:b].tobytes()

    @cached_property
    def consistent(self) -> bool:
        """Every token is what its own bytes encode to."""
        tokens = [t for t in self.ranks if len(t) > 1]
        for at in range(0, len(tokens), 20_000):
            some = tokens[at : at + 20_000]
            if any(len(ids) != 4 for _, ids in self._contracted(some, _WIDE)):
                return False
        return True

    def encode(self, batch: list[str]) -> pa.ListArray:
        cut = [self.find(t) for t in batch]
        if len(self.cache) > CACHE:
            self.cache.clear()
        known = self.cache
        self.learn(set(chain.from_iterable(cut)).difference(known))
        ids = [b"".join(map(known.__getitem__, words)) for words in cut]
        offsets = np.cumsum([0, *map(len, ids)]) // 4
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


class Decoder(Worker):
    """Vocabulary; a byte is kept as the character of its code, so that texts concatenate in SQL."""

    def __init__(self, path: str) -> None:
        super().__init__()
        ranks = _ranks(path)
        self._put("vocabulary", {"id": pa.array(ranks.values(), pa.int32()), "s": pa.array([t.decode("latin-1") for t in ranks])})

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of each row's ids."""
        out, cuts = [b""] * len(ids), ids.offsets.to_numpy()
        values = ids.values.to_numpy()
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + DECODE_IDS)) - 1)
            n = np.diff(cuts[at : to + 1])
            rows = {"d": np.repeat(np.arange(at, to, dtype=np.int32), n), "i": np.arange(n.sum(), dtype=np.int32), "id": values[cuts[at] : cuts[to]]}
            self.db.register("encoded", pa.table(rows))
            for d, text in self.db.sql(_DECODE).fetchall():
                out[d] = text.encode("latin-1")
            self.db.unregister("encoded")
            at = to
        return out


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def slices(batches, rows: int = 2048):
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def plain(batch: pa.RecordBatch) -> pa.ListArray:
    """The ids column with offsets from 0; null ids are no ids."""
    ids = batch.column("ids")
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), ids.flatten())


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, release: bool = False) -> DataFrame:
    """doc_id and the ids of each whole text. ``path`` must be readable on every executor. With ``release`` a worker
    drops its tables and cache after each task: less memory between stages, more time."""
    path, pattern = path or _vocabulary()[0], pattern or _vocabulary()[1]

    def run(batches):
        codec = _codec(path, pattern)
        for batch in _released(pieces(batches, "text", 2_500_000), *[_codec] * release):
            yield batch_of(_IDS, {"doc_id": batch.column("doc_id"), "ids": codec.encode(batch.column("text").to_pylist())})

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _digest_of(doc_id: pa.Array, ids: pa.ListArray, decoder: Decoder) -> pa.RecordBatch:
    cuts, data = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
    return batch_of(
        _DIGEST,
        {
            "doc_id": doc_id,
            "n_tokens": np.diff(cuts),
            "ids_sha256": [hashlib.sha256(data[a:b].tobytes()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoder.decode(ids)],
        },
    )


def digests(encoded: DataFrame, path: str | None = None, release: bool = False) -> DataFrame:
    """Decodes the ids and returns digests of ids and decoded bytes."""
    path = path or _vocabulary()[0]

    def run(batches):
        decoder = _decoder(path)
        for batch in _released(slices(batches), *[_decoder] * release):
            yield _digest_of(batch.column("doc_id"), plain(batch), decoder)

    return encoded.select("doc_id", "ids").mapInArrow(run, DIGEST)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, release: bool = False) -> DataFrame:
    """The rows of ``digests(encode(docs))`` from one worker for each task instead of two: ids don't go through the JVM,
    and an executor holds half as many processes."""
    path, pattern = path or _vocabulary()[0], pattern or _vocabulary()[1]

    def run(batches):
        codec, decoder = _codec(path, pattern), _decoder(path)
        for batch in _released(pieces(batches, "text", 2_500_000), *[_codec, _decoder] * release):
            yield _digest_of(batch.column("doc_id"), codec.encode(batch.column("text").to_pylist()), decoder)

    return texts(docs).mapInArrow(run, DIGEST)


def decode(encoded: DataFrame, path: str | None = None, release: bool = False) -> DataFrame:
    """doc_id and the decoded bytes."""
    path = path or _vocabulary()[0]

    def run(batches):
        codec = _decoder(path)
        for batch in _released(slices(batches), *[_decoder] * release):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codec.decode(plain(batch)), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
