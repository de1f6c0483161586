"""Language-model scoring by a trie of n-grams in Elias-Fano levels.

The first level holds the 64-bit names of the training words in order, so a word's id is its place, and their running
counts. The second holds the words that occur as contexts, monotone pointers from a context to its successors, the
successors' ids, each list shifted by the last value of the list before it so that the whole is monotone, and for
each pair the quantised logarithm of its smoothed probability c(h w) / (c(h) + mu). A pair is searched relative to its
context: the pointers bound its successors, the value before them is the shift, and only between these bounds does a value
name a successor. With the probability of single words the model is

    P(w | h) = c(h w) / (c(h) + mu) + mu / (c(h) + mu) * P(w),    P(w) = (c(w) + 1) / (N + V + 1).

Levels are cut in files of bounded size in the shared folder. Texts are cut once into chunks of many tokens, kept there as
files of numbers. Look-ups travel to the levels, not levels to the look-ups: a chunk's distinct words, then its distinct pairs, are
dealt out by the file that answers them, each file is opened by one task, and the answers go back by chunk. So work
grows with the tokens, however many files a level has. Pairs are dealt by their estimated place in the order of contexts and
successors, so that a frequent context is spread over several files. Counts are gathered from all training texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .elias_fano import EliasFano
from .files import Folder, laid_out, layout, press, unpress
from .spark import groups, settle, shared_dir, whole_groups

END = np.uint64(1)
CHUNK, WORDS_A_FILE, PAIRS_A_FILE, MU = 2_000_000, 1 << 18, 2_000_000, 64.0
_MISS = 65535


def _sequences(parts: dict[str, np.ndarray], extra: dict[str, np.ndarray]) -> bytes:
    made = {p: EliasFano.arrays(v) for p, v in parts.items()}
    return layout({f"{p}.{k}": v for p, (_, found) in made.items() for k, v in found.items()} | extra, {p: h for p, (h, _) in made.items()})


class Level:
    """One file of a level, memory-mapped where the folder is local."""

    def __init__(self, folder: Folder, name: str):
        self.arrays, self.heads = laid_out(folder.whole(name))

    def sequence(self, name: str) -> EliasFano:
        h = self.heads[name]
        return EliasFano(h["n"], h["bits"], *(self.arrays[f"{name}.{k}"] for k in ("low", "high", "ones")))


@dataclass
class Model:
    """Where the levels are. ``tokens`` is N, ``words`` V; the k-th file of words holds the names whose first ``bits``
    bits are k, its first id is ``first[k]`` and ``before[k]`` training tokens come before it."""

    folder: Folder
    tokens: int
    words: int
    bits: int
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    before: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    files: int = 1
    mu: float = MU

    @property
    def word_files(self) -> list[str]:
        return [f"words-{k}" for k in range(1 << self.bits)]

    @property
    def pair_files(self) -> list[str]:
        return [f"pairs-{k}" for k in range(self.files)]

    def remove(self) -> None:
        """Deletes the levels."""
        self.folder.remove()

    def base(self, k: np.ndarray | int):
        return np.asarray(k, np.uint64) << np.uint64(64 - self.bits) if self.bits else np.uint64(0)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.words + 1)

    def place(self, before: np.ndarray, count: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The file of a pair: its context's place among all tokens, and its successor's share of the ids."""
        at = (before + count * (after / max(1, self.words))) * (self.files / max(1, self.tokens))
        return np.clip(at.astype(np.int64), 0, self.files - 1)

    def answer_words(self, k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of names of the k-th file (-1: unknown), the counts of all words before them, and their counts."""
        ids, before, count = np.full(len(names), -1, np.int64), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        if not self.folder.has(f"words-{k}"):
            return ids, before, count
        level = Level(self.folder, f"words-{k}")
        at = level.sequence("name").find(names - self.base(k))
        hit = np.flatnonzero(at >= 0)
        running = level.sequence("running")
        low, high = running.get(at[hit]).astype(np.int64), running.get(at[hit] + 1).astype(np.int64)
        ids[hit], before[hit], count[hit] = self.first[k] + at[hit], self.before[k] + low, high - low
        return ids, before, count

    def answer_pairs(self, k: int, context: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, float]:
        """Codes of pairs of the k-th file's range (65535 where there is none) and what a step of the code is worth."""
        codes = np.full(len(context), _MISS, np.uint16)
        if not self.folder.has(f"pairs-{k}"):
            return codes, 0.0
        level = Level(self.folder, f"pairs-{k}")
        first = int(level.arrays["first"][0])
        inside = np.flatnonzero(context >= first)
        place = level.sequence("context").find((context[inside] - first).astype(np.uint64))
        seen, place = inside[place >= 0], place[place >= 0]
        pointer, successor = level.sequence("pointer"), level.sequence("successor")
        lo, hi = pointer.get(place).astype(np.int64), pointer.get(place + 1).astype(np.int64)
        shift = np.where(lo > 0, successor.get(np.maximum(lo, 1) - 1), np.uint64(0))
        at = successor.within(after[seen].astype(np.uint64) + shift, lo, hi)
        codes[seen[at >= 0]] = level.arrays["code"][at[at >= 0]]
        return codes, float(level.arrays["step"][0])


def _pairs_level(c: np.ndarray, w: np.ndarray, n: np.ndarray, of_context: np.ndarray, mu: float) -> bytes:
    """A file of sorted distinct pairs: contexts, successors, their counts and their contexts' counts."""
    start = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
    size = np.diff([*start, len(c)])
    last = w[np.append(start[1:], len(c)) - 1].astype(np.uint64)
    shift = np.concatenate([[np.uint64(0)], last.cumsum(dtype=np.uint64)[:-1]])
    lost = -np.log10(n / (of_context + mu))
    step = max(float(lost.max()), 1e-9) / (_MISS - 1)
    parts = {"context": (c[start] - c[0]).astype(np.uint64), "pointer": np.append(start, len(c)).astype(np.uint64), "successor": w.astype(np.uint64) + np.repeat(shift, size)}
    return _sequences(parts, {"code": np.round(lost / step).astype("<u2"), "step": np.array([step]), "first": np.array([c[0]], "<i8")})


def _merged(found: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
    """The pairs of several blobs in order, each once, with the sum of their counts."""
    c, w, n, of = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in ("c", "w", "n", "of"))
    order = np.lexsort((w, c))
    c, w, n, of = c[order], w[order], n[order], of[order]
    start = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
    return [c[start], w[start], np.add.reduceat(n, start), of[start]]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows with the names of their tokens, an end after each text, and the number of tokens of each; many texts
    at a time, a text is never cut."""
    held: list[pa.RecordBatch] = []
    names: list[np.ndarray] = []
    total = 0
    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column(0)):
            h = np.append(words.word_hashes(text.as_py()), END)
            names.append(h)
            total += len(h)
            if total >= size:
                held.append(batch.slice(start, i + 1 - start).drop_columns(["text"]))
                yield pa.Table.from_batches(held), np.concatenate(names), np.array([len(x) for x in names])
                held, names, total, start = [], [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start).drop_columns(["text"]))
    if names:
        yield pa.Table.from_batches(held), np.concatenate(names), np.array([len(x) for x in names])


def _cut(docs: DataFrame, folder: Folder, id_column: str, text_column: str, held: Column, learn: Column) -> DataFrame:
    """``(chunk, names)``: files of the tokens of many texts, as places among the chunk's sorted distinct names, and of these
    names with their counts in the texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, names, sizes in _chunks(batches, CHUNK):
            name, inverse = np.unique(np.append(names, END), return_inverse=True)
            token = inverse[:-1]
            ids = rows["id"].combine_chunks()
            mark = lambda c: rows[c].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
            learnt = mark("learn")
            counts = np.bincount(token[np.repeat(learnt, sizes)], minlength=len(name))
            chunk = press({
                "id": ids.fill_null(0).to_numpy(), "valid": ids.is_valid().to_numpy(zero_copy_only=False), "held": mark("held"), "learn": learnt,
                "size": sizes.astype("<i8"), "token": token.astype("<u4"), "end": np.searchsorted(name, [END]).astype("<u4"),
            })
            yield pa.RecordBatch.from_pydict({"chunk": [folder.write(".chunk", chunk)], "names": [folder.write(".names", press({"name": name, "count": counts.astype("<i8")}))]})

    columns = [F.col(text_column).cast("binary").alias("text"), F.col(id_column).cast("long").alias("id"), held.cast("boolean").alias("held"), learn.cast("boolean").alias("learn")]
    return settle(docs.select(columns).mapInArrow(run, "chunk string, names string"))


def _vocabulary(chunks: DataFrame, folder: Folder, levels: Folder, mu: float, words_a_file: int, pairs_a_file: int) -> Model:
    """Counts the words to learn and writes the first level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("names").to_pylist():
                found = unpress(folder.whole(file))
                k = found["count"] > 0
                yield pa.RecordBatch.from_arrays([pa.array(found["name"][k].view(np.int64)), pa.array(found["count"][k])], ["name", "n"])

    counted = settle(chunks.mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")))
    n_words, n_tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (n_words // words_a_file).bit_length())
    shard = F.shiftrightunsigned("name", 64 - bits) if bits else F.lit(0).cast("long")
    model = Model(levels, n_tokens, n_words, bits, files=max(1, -(-n_tokens // pairs_a_file)), mu=mu)

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches, ["shard"], 1):
            for a, b in zip(cuts, cuts[1:]):
                k = t["shard"][a].as_py()
                name = t["name"].slice(a, b - a).to_numpy().view(np.uint64)
                order = np.argsort(name)
                running = np.concatenate([[0], t["n"].slice(a, b - a).to_numpy()[order].cumsum()]).astype(np.uint64)
                levels.put(f"words-{k}", _sequences({"name": name[order] - model.base(k), "running": running}, {}))
                yield pa.RecordBatch.from_pydict({"shard": [k], "n": [b - a], "total": [int(running[-1])]})

    dealt = counted.withColumn("shard", shard).repartitionById(1 << bits, F.col("shard").cast("int")).sortWithinPartitions("shard")
    sizes = np.zeros((2, 1 << bits), np.int64)
    for r in settle(dealt.mapInArrow(first_level, "shard long, n long, total long")).toLocalIterator():
        sizes[:, r.shard] = r.n, r.total
    model.first, model.before = np.concatenate([[[0], [0]], sizes.cumsum(1)[:, :-1]], 1)
    return model


def _numbered(chunks: DataFrame, folder: Folder, model: Model) -> DataFrame:
    """``(chunk, numbers)``: beside each chunk a file with its names' ids, counts and the counts before them.

    Names are asked of the files of the first level, each of which is opened once; the files of names go."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, file in zip(batch.column("chunk").to_pylist(), batch.column("names").to_pylist()):
                name = unpress(folder.whole(file))["name"]
                cut = np.append(np.searchsorted(name, model.base(np.arange(1 << model.bits))) if model.bits else [0], len(name))
                shards = np.flatnonzero(np.diff(cut)).tolist()
                blobs = [name[cut[k] : cut[k + 1]].astype("<u8").tobytes() for k in shards]
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array([chunk] * len(shards), pa.string()), pa.array(blobs, pa.binary())], ["shard", "chunk", "blob"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches, ["shard"], 1):
            for a, b in zip(cuts, cuts[1:]):
                asked = [np.frombuffer(x.as_py(), "<u8") for x in t["blob"].slice(a, b - a)]
                edge = np.cumsum([0, *map(len, asked)])
                found = model.answer_words(t["shard"][a].as_py(), np.concatenate(asked))
                blobs = [press({k: v[i:j] for k, v in zip(("id", "before", "count"), found)}) for i, j in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([t["shard"].slice(a, b - a).combine_chunks(), t["chunk"].slice(a, b - a).combine_chunks(), pa.array(blobs, pa.binary())], ["shard", "chunk", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["chunk"]):
            found = [unpress(x.as_py()) for x in t["blob"]]
            raw = press({k: np.concatenate([f[k] for f in found]) for k in ("id", "before", "count")})
            yield pa.RecordBatch.from_pydict({"chunk": [t["chunk"][0].as_py()], "numbers": [folder.write(".numbers", raw)]})

    schema = "shard long, chunk string, blob binary"
    asked = chunks.mapInArrow(ask, schema).repartitionById(1 << model.bits, F.col("shard").cast("int")).sortWithinPartitions("shard")
    told = asked.mapInArrow(answer, schema).repartition("chunk").sortWithinPartitions("chunk", "shard")
    out = settle(told.mapInArrow(gather, "chunk string, numbers string"))
    chunks.select("names").foreachPartition(lambda rows: [folder.delete(r.names) for r in rows])
    return out


class _Chunk:
    """A chunk with its words' numbers and its distinct pairs, as places ``c`` and ``w`` among its names."""

    def __init__(self, folder: Folder, chunk: str, numbers: str, learn: bool):
        self.rows, self.numbers = unpress(folder.whole(chunk)), unpress(folder.whole(numbers))
        self.token = self.rows["token"].astype(np.int64)
        many = np.uint64(len(self.numbers["id"]))
        # the token before each; a text's first token comes after an end, as does the first of all
        both = np.concatenate([self.rows["end"].astype(np.uint64), self.token[:-1].astype(np.uint64)]) * many + self.token.astype(np.uint64)
        if learn:
            local, self.n = np.unique(both[np.repeat(self.rows["learn"], self.rows["size"])], return_counts=True)
        else:
            local, self.back = np.unique(both, return_inverse=True)
        self.c, self.w = (local // many).astype(np.int64), (local % many).astype(np.int64)

    def known(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """The places of the pairs of known words, and their files; ids have the order of names, so files do not fall."""
        ids = self.numbers["id"]
        known = np.flatnonzero((ids[self.c] >= 0) & (ids[self.w] >= 0))
        c = self.c[known]
        return known, model.place(self.numbers["before"][c], self.numbers["count"][c], ids[self.w[known]])

    def blobs(self, model: Model, learn: bool) -> Iterator[tuple[int, bytes]]:
        known, file = self.known(model)
        ids, count = self.numbers["id"], self.numbers["count"]
        cut = np.flatnonzero(np.diff(file, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(file)]):
            k = known[a:b]
            blob = {"c": np.diff(ids[self.c[k]], prepend=0), "w": ids[self.w[k]]}
            if learn:
                blob |= {"n": self.n[k], "of": count[self.c[k]]}
            yield int(file[a]), press(blob)


def _asking(folder: Folder, model: Model, learn: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, numbers in zip(batch.column("chunk").to_pylist(), batch.column("numbers").to_pylist()):
                told = list(_Chunk(folder, chunk, numbers, learn).blobs(model, learn))
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in told], pa.int64()), pa.array([chunk] * len(told), pa.string()), pa.array([b for _, b in told], pa.binary())], ["shard", "chunk", "blob"])

    return run


def _opened(raw: bytes) -> dict[str, np.ndarray]:
    blob = unpress(raw)
    return blob | {"c": blob["c"].cumsum()}


def _learn_pairs(numbered: DataFrame, folder: Folder, model: Model) -> None:
    """Writes the second level."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches, ["shard"], 1):
            for a, b in zip(cuts, cuts[1:]):
                k = t["shard"][a].as_py()
                model.folder.put(f"pairs-{k}", _pairs_level(*_merged([_opened(x.as_py()) for x in t["blob"].slice(a, b - a)]), model.mu))
                yield pa.RecordBatch.from_pydict({"shard": [k]})

    told = numbered.mapInArrow(_asking(folder, model, True), "shard long, chunk string, blob binary")
    dealt = told.select("shard", "blob").repartitionById(model.files, F.col("shard").cast("int")).sortWithinPartitions("shard")
    dealt.mapInArrow(build, "shard long").agg(F.count("*")).first()


def _scored(numbered: DataFrame, folder: Folder, model: Model) -> DataFrame:
    """The scores of all texts of the chunks, kept in the shared folder."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches, ["shard"], 1):
            for a, b in zip(cuts, cuts[1:]):
                asked = [_opened(x.as_py()) for x in t["blob"].slice(a, b - a)]
                edge = np.cumsum([0, *(len(x["c"]) for x in asked)])
                codes, step = model.answer_pairs(t["shard"][a].as_py(), *(np.concatenate([x[k] for x in asked]) for k in "cw"))
                blobs = [press({"code": codes[i:j], "step": np.array([step])}) for i, j in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([t["shard"].slice(a, b - a).combine_chunks(), t["chunk"].slice(a, b - a).combine_chunks(), pa.array(blobs, pa.binary())], ["shard", "chunk", "blob"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["chunk"]):
            chunk = _Chunk(folder, t["chunk"][0].as_py(), t["numbers"][0].as_py(), False)
            rows, count = chunk.rows, chunk.numbers["count"]
            single = np.log10(model.unigram(count))
            share = np.zeros(len(chunk.c))
            answers = [unpress(x.as_py()) for x in t["blob"].slice(1)]  # the first row names the chunk's files
            if answers:
                codes, steps = np.concatenate([x["code"] for x in answers]), np.repeat([x["step"][0] for x in answers], [len(x["code"]) for x in answers])
                share[chunk.known(model)[0]] = np.where(codes == _MISS, 0.0, 10.0 ** (-codes.astype(np.float64) * steps))
            logs = np.log10(share + model.mu / (count[chunk.c] + model.mu) * model.unigram(count[chunk.w]))
            start = np.concatenate([[0], rows["size"].cumsum()[:-1]])
            sums = [np.add.reduceat((count > 0)[chunk.token].astype(np.int64), start), np.full(len(start), model.tokens, np.int64), np.add.reduceat(single[chunk.token], start), np.add.reduceat(logs[chunk.back], start)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["id"], mask=~rows["valid"]), pa.array(rows["held"]), pa.array(rows["size"]), *map(pa.array, sums)],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "shard long, chunk string, blob binary"
    asked = numbered.mapInArrow(_asking(folder, model, False), schema).repartitionById(model.files, F.col("shard").cast("int")).sortWithinPartitions("shard")
    told = asked.mapInArrow(answer, schema).withColumn("numbers", F.lit(None).cast("string"))
    named = numbered.select(F.lit(-1).cast("long").alias("shard"), "chunk", F.lit(None).cast("binary").alias("blob"), "numbers")
    dealt = named.unionByName(told).repartition("chunk").sortWithinPartitions("chunk", "shard")
    return settle(dealt.mapInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def _folder(docs: DataFrame, kind: str) -> Folder:
    return Folder(f"{shared_dir(docs.sparkSession)}/{kind}-{uuid.uuid4().hex}")


def train(docs: DataFrame, text_column: str = "text", *, mu: float = MU, words_a_file: int = WORDS_A_FILE, pairs_a_file: int = PAIRS_A_FILE) -> Model:
    """Counts all words and pairs of ``docs`` and writes the levels, which stay until :meth:`Model.remove`.

    Null texts are texts of no words, each of repeated rows counts, an empty table gives a model without words. Only the
    text is read, so other columns' names don't matter.
    """
    work = _folder(docs, "lm-work")
    texts = docs.select(F.lit(None).alias("id"), F.col(text_column).alias("text"))
    chunks = _cut(texts, work, "id", "text", F.lit(False), F.lit(True))
    model = _vocabulary(chunks, work, _folder(docs, "lm"), mu, words_a_file, pairs_a_file)
    if model.words:
        _learn_pairs(_numbered(chunks, work, model), work, model)
    work.remove()
    return model


def scores(docs: DataFrame, model: Model, held: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of each row's whole text.

    ``base_score`` is the text's log10 probability by single words, ``score`` by the trie; a null or empty text has
    one token, the end. Without training texts every word is unknown, with probability 1. Each of repeated rows is
    scored, a null id stays null, a null ``held`` is false, an empty table gives no rows. Only the columns named are read.
    """
    work = _folder(docs, "lm-work")
    out = _scored(_numbered(_cut(docs, work, id_column, text_column, held, F.lit(False)), work, model), work, model)
    work.remove()
    return out


def fold_scores(docs: DataFrame, held: Column, id_column: str = "doc_id", text_column: str = "text", *, mu: float = MU, words_a_file: int = WORDS_A_FILE, pairs_a_file: int = PAIRS_A_FILE) -> DataFrame:
    """The scores of all rows by a model of those that are not ``held``, as :func:`train` and :func:`scores` give them;
    texts are cut into tokens once for both. A row whose ``held`` is null is learnt from."""
    work, levels = _folder(docs, "lm-work"), _folder(docs, "lm")
    chunks = _cut(docs, work, id_column, text_column, held, ~F.coalesce(held, F.lit(False)))
    model = _vocabulary(chunks, work, levels, mu, words_a_file, pairs_a_file)
    numbered = _numbered(chunks, work, model)
    if model.words:
        _learn_pairs(numbered, work, model)
    out = _scored(numbered, work, model)
    work.remove()
    model.remove()
    return out
