"""Fill-in-the-middle documents, cut by a parallel scan of an automaton.

A text is cut between tokens (runs of ASCII letters, or any other single code point). Which bytes begin a token, and
whether the text holds one of the marks, is told by an automaton of four states over bytes. Texts are scanned in chunks:

1. a chunk's function says for every state it may be entered in: the state after it, the tokens that begin in it, and
   whether it completes a mark;
2. functions of chunks are composed, which is associative, so a chunk needs to know nothing of the ones before; composed
   prefixes give every chunk's true entry state and the tokens before it;
3. a cut is a token's number: the chunk that holds it is known from the counts, and finds its place.

A document of up to CHUNK code points is one chunk and is cut where it is read. The chunks of longer ones are dealt over
all tasks, and only functions of chunks and places of cuts meet their documents again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, free_name, settle, small, tidy

#: Code points of a chunk, and chunks of a document at most: those of a longer document are longer.
CHUNK, MOST_CHUNKS = 1 << 16, 64
#: Shares in per cent: documents that stay as they are, and those of the others with the suffix first.
PLAIN, SPM = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: States: after anything else, within letters, after "<", and within letters after "<P", "<S" or "<M".
OTHER, WORD, OPEN, NAMED = range(4)
#: Classes of bytes: further bytes of a code point, any other non-letter, "<", ">", letters, and P, S, M.
REST, SIGN, LESS, MORE, LETTER, NAME = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    out[0x80:0xC0] = REST
    out[[*range(65, 91), *range(97, 123)]] = LETTER
    out[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = NAME
    out[ord("<")], out[ord(">")] = LESS, MORE
    return out


CLASS = _classes()
#: The next state by state and class, and whether the byte begins a token or completes a mark.
NEXT = np.array([[OTHER, OTHER, OPEN, OTHER, WORD, NAMED if s == OPEN else WORD] for s in range(4)], np.uint8)
BEGINS = np.array([[False, True, True, True, s in (OTHER, OPEN), s in (OTHER, OPEN)] for s in range(4)])
MARKS = np.array([[s == NAMED and c == MORE for c in range(6)] for s in range(4)])


class Chunk:
    """What the automaton does in a chunk of UTF-8, whatever state it is entered in.

    Two bytes on, the state no longer depends on the first one (NEXT maps all states alike after two steps), so all
    states after the second byte are looked up at once.
    """

    def __init__(self, raw: bytes):
        self.cls = CLASS[np.frombuffer(raw, np.uint8)]
        alone = NEXT[OTHER].take(self.cls)
        before = np.zeros(len(self.cls), np.uint8)
        before[2:] = NEXT.ravel().take(alone[:-2] * np.uint8(6) + self.cls[1:-1])
        self.cell = before * np.uint8(6) + self.cls
        self.last = int(before[-1]) if len(before) > 2 else OTHER

    def cells(self, state: int) -> np.ndarray:
        """(state before, class) of every byte, as places in the flat tables, when entered in this state."""
        for i, c in enumerate(self.cls[:2].tolist()):
            self.cell[i], state = state * 6 + c, int(NEXT[state, c])
        return self.cell

    def function(self) -> list[tuple[int, int, bool]]:
        """For each entry state: the state after the chunk, the tokens that begin in it, and whether it completes a mark."""
        return [self.entered(s) for s in range(4)]

    def entered(self, state: int) -> tuple[int, int, bool]:
        cell = self.cells(state)
        if not len(cell):
            return state, 0, False
        return int(NEXT.ravel()[cell[-1]]), int(np.count_nonzero(BEGINS.ravel().take(cell))), bool((cell == NAMED * 6 + MORE).any())

    def places(self, state: int, tokens: list[int]) -> list[int]:
        """Code points before these tokens of the chunk, the first being 0; all of them where there is no such token."""
        begins = np.flatnonzero(BEGINS.ravel().take(self.cells(state)))
        ends = [int(begins[t]) if t < len(begins) else len(self.cls) for t in tokens]
        return [int(np.count_nonzero(self.cls[:e] != REST)) for e in ends]


def compose(a: list[tuple[int, int, bool]], b: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    """The function of two chunks in a row; associative."""
    return [(b[end][0], n + b[end][1], hit or b[end][2]) for end, n, hit in a]


def _cuts(n: int, h1: int, h2: int) -> list[int]:
    """Tokens before the end of the prefix and of the middle."""
    return sorted((h1 % (n + 1), h2 % (n + 1)))


def _cut_here(raw: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    out = []
    for r, x, y in zip(raw, h1, h2, strict=True):
        c = Chunk(r)
        _, n, marked = c.entered(OTHER)
        out.append((n, marked, *c.places(OTHER, _cuts(n, x, y))))
    return pd.DataFrame(out, columns=["n", "marked", "a", "b"])


def _draws(key: Column) -> list[Column]:
    """The first four groups of eight digits of the SHA-256 of "1:" and the id, as numbers."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _chunks(giants: DataFrame, chunk: int) -> DataFrame:
    """(tk, i, part): the chunks of different texts. Copies of a text are one before they are shuffled."""
    step = F.greatest(F.lit(chunk).cast("long"), F.ceil(F.length("t") / F.lit(MOST_CHUNKS)))
    d = giants.select("t", "tk", step.alias("step")).select("*", F.explode(F.sequence(F.lit(0), F.expr("cast((length(t) - 1) div step as int)"))).alias("i"))
    return d.select("tk", "i", F.col("t").substr((F.col("i") * F.col("step") + 1).cast("int"), F.col("step").cast("int")).alias("part")).groupBy("tk", "i").agg(F.any_value("part").alias("part"))


def _cut_apart(giants: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tk, id, n, marked, a, b) of giants(id, tk, h1, h2, ...) by the functions of their chunks."""

    @tidy
    def functions(batches):
        for b in small(batches, 16):
            parts = b.column(2).cast(pa.binary()).to_pylist()
            found = [Chunk(p) for p in parts]
            chars = [int(np.count_nonzero(c.cls != REST)) for c in found]
            flat = [[int(x) for f in c.function() for x in f] for c in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(flat, pa.list_(pa.int64())), pa.array(chars, pa.int64())], names=["tk", "i", "f", "chars"])

    def entries(t: pa.Table) -> pa.Table:
        """Of a text's chunks, MOST_CHUNKS and one at most: the composed prefixes."""
        t = t.sort_by("i")
        fs = [[tuple(f[3 * s : 3 * s + 3]) for s in range(4)] for f in t.column("f").to_pylist()]
        state, n, chars, out = OTHER, 0, 0, []
        whole = reduce(compose, fs)[OTHER]
        for f, c in zip(fs, t.column("chars").to_pylist(), strict=True):
            out.append((state, n, chars))
            state, n, chars = f[state][0], n + f[state][1], chars + c
        states, before, at = map(list, zip(*out, strict=True))
        same = lambda v, k: pa.array([v] * len(out), k)
        return pa.table({"tk": t.column("tk"), "i": t.column("i"), "state": pa.array(states, pa.int32()), "before": pa.array(before, pa.int64()), "at": pa.array(at, pa.int64()), "n": same(whole[1], pa.int64()), "marked": same(bool(whole[2]), pa.bool_())})

    @tidy
    def select(batches):
        for b in small(batches, 16):
            rows = [Chunk(p).places(s, [k])[0] for p, s, k in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x + y for x, y in zip(rows, b.column(5).to_pylist(), strict=True)], pa.int64())], names=["asked", "which", "place"])

    told = chunks.mapInArrow(functions, "tk string, i int, f array<long>, chars long").groupBy("tk").applyInArrow(entries, "tk string, i int, state int, before long, at long, n long, marked boolean")
    told = settle(told)
    asked = giants.select("tk", "id", "h1", "h2").distinct().join(told.filter("i = 0").select("tk", "n", "marked"), "tk")
    first, second = F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")
    both = F.array(F.struct(F.lit(0).alias("which"), F.least(first, second).alias("token")), F.struct(F.lit(1).alias("which"), F.greatest(first, second).alias("token")))
    asked = settle(asked.withColumn("asked", F.struct("tk", "id")).select("tk", "n", "marked", "asked", F.inline(both)))
    # The last chunk that begins at or before the token, found among the text's few chunks.
    firsts = told.groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("i", "state", "before", "at"))).alias("all"))
    found = asked.join(firsts, "tk").withColumn("c", F.element_at(F.filter("all", lambda c: c["before"] <= F.col("token")), -1))
    found = found.select("tk", F.col("c.i").alias("i"), "asked", "which", F.col("c.state").alias("state"), (F.col("token") - F.col("c.before")).alias("token"), F.col("c.at").alias("at"))
    places = found.join(chunks, ["tk", "i"]).select("asked", "which", "part", "state", "token", "at").mapInArrow(select, "asked struct<tk: string, id: string>, which int, place long")
    cut = places.groupBy("asked").agg(F.max(F.when(F.col("which") == 0, F.col("place"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("place"))).alias("b"))
    return asked.filter("which = 0").select("asked", "n", "marked").join(cut, "asked").select("asked.tk", "asked.id", "n", "marked", "a", "b")


NAMES = ["n", "form", "prefix_chars", "middle_chars", "output"]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs and n (tokens of the whole text), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    A null or empty text, and one that holds a mark, is plain: its output is the text, null as empty. A null id draws as
    the empty one; repeated rows are cut alike; an empty table gives no rows. Columns of docs that have one of the new
    names, whatever the case, give way; others stay, whatever their names.
    """
    keep = [c for c in docs.columns if c.lower() not in NAMES]
    box, = free_name(docs, "box__")
    col = lambda c: columns(docs, [c])[0]
    draws = [d.alias(f"h{i}") for i, d in enumerate(_draws(col(key)), 1)]
    d = docs.select(F.struct(*columns(docs, keep)).alias(box), F.coalesce(col(text), F.lit("")).alias("t"), F.coalesce(col(key).cast("string"), F.lit("")).alias("id"), *draws)
    here = d.filter(F.length("t") <= chunk).withColumn("c", F.pandas_udf(_cut_here, "n long, marked boolean, a long, b long")(F.col("t").cast("binary"), "h1", "h2"))
    long = d.filter(F.length("t") > chunk).withColumn("tk", F.sha2("t", 256))
    chunks = settle(_chunks(long, chunk))
    if not chunks.isEmpty():
        cuts = _cut_apart(long, chunks).select("tk", "id", F.struct("n", "marked", "a", "b").alias("c"))
        here = here.unionByName(long.join(cuts, ["tk", "id"]).select(*here.columns))
    plain = (F.col("t") == "") | F.col("c.marked") | (F.col("h3") % 100 >= 100 - PLAIN)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM, "spm").otherwise("psm")
    out = here.select(box, "t", F.col("c.n").alias("n"), form.alias("form"), F.col("c.a").cast("int").alias("a"), (F.col("c.b") - F.col("c.a")).cast("int").alias("m"))
    part = lambda at, n: F.col("t").substr(at, n)
    prefix, middle, suffix = part(F.lit(1), F.col("a")), part(F.col("a") + 1, F.col("m")), part(F.col("a") + F.col("m") + 1, F.length("t"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    return out.select(
        f"{box}.*", "n", "form", F.when(cut, F.col("a").cast("long")).alias("prefix_chars"), F.when(cut, F.col("m").cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: what is cut holds no mark, so the marks in an output are its own."""
    part = lambda i: F.split(output, "<[PSM]>", 4)[i]
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
