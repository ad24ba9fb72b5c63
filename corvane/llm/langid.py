"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, few, settle, spread

#: Documents of each language that training reads, at most, and pieces of each document. Every labelled language is
#: learned: where there are more than SAMPLE_ALL // SAMPLE_DOCS of them, each has fewer documents, LEAST_DOCS at least.
SAMPLE_DOCS, SAMPLE_PIECES, SAMPLE_ALL, LEAST_DOCS = 300, 4, 20_000, 20
#: Bytes of a piece: the network starts anew with each, and the pieces cover the whole text.
PIECE = 96
#: Bytes of a row that the pass over all documents is sent: an Arrow batch of 10,000 rows is 7.7 MB however long the texts are.
CHUNK = 8 * PIECE
#: Pieces that are labelled side by side: 6 MB of states and 0.4 MB a language.
BLOCK = 1024
HIDDEN, ROUNDS, BATCH, RATE = 8, 10, 128, 0.02
#: Updates of the weights, at least: a small sample is gone through more often, in smaller batches.
LEAST_UPDATES = 500
#: A batch of the pass over all documents: pieces in the order of the rows, mixed within a pool of POOL, and beside them
#: AGAIN pieces of the sample, so that rows sorted by language don't make it forget the others.
STREAM, AGAIN, POOL, STREAM_RATE = 384, 128, 8192, 0.003
#: Batches of a lane, at least: rows that fit into one pool are gone through more often.
LEAST_STEPS = 100
#: Bytes of a lane of the pass over all documents, and lanes, at most: beyond their product lanes grow.
LANE, MOST_LANES = 2 << 20, 50_000
#: Weights times pieces are summed as whole numbers of this fraction: sums are exact, in any order.
UNIT = 1 << 16
#: least_score() counts held-out scores by this fraction.
SCORE_BINS = 10_000
PAD = 256
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class _Adam:
    """Running moments of the gradients of weights, which are stepped in place; gradients of a norm above 1 are cut to it."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p, self.steps = p, 0
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.v = {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, d: dict[str, np.ndarray], pace: float) -> None:
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in d.values())))
        self.steps += 1
        for k, g in d.items():
            g *= min(1.0, 1.0 / (norm + 1e-9))
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= pace * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-7)


@dataclass
class BiGru:
    """Weights of both directions side by side: axis 0 is the direction, features come before the batch.

    e: (2, 3H, 257) input of each byte to the gates reset, update and candidate; u: (2, 3H, H); c: (2, H, 1) the
    candidate's own bias inside the reset; w: (L, 2H) and b: (L, 1) label every position.
    """

    langs: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> BiGru:
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        return cls(
            langs,
            {
                "e": normal(2, 3 * hidden, PAD + 1, scale=0.5),
                "u": normal(2, 3 * hidden, hidden, scale=hidden**-0.5),
                "c": np.zeros((2, hidden, 1), np.float32),
                "w": normal(len(langs), 2 * hidden, scale=0.5),
                "b": np.zeros((len(langs), 1), np.float32),
            },
        )

    def run(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """codes (T, B) -> states (T, 2H, B). keep receives what backpropagation needs of each step."""
        e, u, c = self.p["e"], self.p["u"], self.p["c"]
        n, (steps, size) = u.shape[2], codes.shape
        h = np.zeros((2, n, size), np.float32)
        out = np.empty((steps, 2 * n, size), np.float32)
        g, x = np.empty((2, 3 * n, size), np.float32), np.empty((2, 3 * n, size), np.float32)
        for t in range(steps):
            np.take(e[0], codes[t], axis=1, out=x[0], mode="clip")
            np.take(e[1], codes[steps - 1 - t], axis=1, out=x[1], mode="clip")
            np.matmul(u, h, out=g)
            s = x[:, : 2 * n] + g[:, : 2 * n]
            s *= 0.5
            np.tanh(s, out=s)
            s += 1.0
            s *= 0.5
            r, z = s[:, :n], s[:, n:]
            q = g[:, 2 * n :] + c
            a = r * q
            a += x[:, 2 * n :]
            np.tanh(a, out=a)
            if keep is not None:
                keep.append((h, r.copy(), z.copy(), q, a))
            h = a + z * (h - a)
            out[t, :n] = h[0]
            out[steps - 1 - t, n:] = h[1]
        return out

    def label(self, states: np.ndarray) -> np.ndarray:
        """States (T, 2H, B) -> probabilities (T, L, B) of every position."""
        y = np.matmul(self.p["w"], states)
        y += self.p["b"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, codes: np.ndarray, truth: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions that are text, and its gradients by backpropagation through time.

        weight says how much each piece counts; without it, all count alike.
        """
        u, n, steps = self.p["u"], self.p["u"].shape[2], codes.shape[0]
        keep: list = []
        states = self.run(codes, keep)
        prob = self.label(states)
        mask = (codes != PAD).astype(np.float32)
        if weight is not None:
            mask *= weight.astype(np.float32)
        total = max(1.0, float(mask.sum()))
        batch = np.arange(codes.shape[1])
        loss = -float((np.log(prob[:, truth, batch] + 1e-9) * mask).sum()) / total
        dy = prob
        dy[:, truth, batch] -= 1.0
        dy *= (mask / total)[:, None, :]
        d = {k: np.zeros_like(v) for k, v in self.p.items()}
        d["w"] = np.einsum("tlb,thb->lh", dy, states, optimize=True)
        d["b"] = dy.sum(axis=(0, 2))[:, None]
        ds = np.matmul(self.p["w"].T, dy)
        dh = np.zeros((2, n, codes.shape[1]), np.float32)
        size = d["e"].shape[1:]
        base = (np.arange(size[0]) * size[1])[:, None]
        for t in reversed(range(steps)):
            h, r, z, q, a = keep[t]
            dh = dh + np.stack([ds[t, :n], ds[steps - 1 - t, n:]])
            da = dh * (1 - z) * (1 - a * a)
            dz = dh * (h - a) * z * (1 - z)
            dq = da * r
            dr = da * q * r * (1 - r)
            dg = np.concatenate([dr, dz, dq], axis=1)
            d["u"] += np.matmul(dg, h.transpose(0, 2, 1))
            d["c"] += dq.sum(axis=2, keepdims=True)
            dx = np.concatenate([dr, dz, da], axis=1)
            for side, code in ((0, codes[t]), (1, codes[steps - 1 - t])):
                d["e"][side] += np.bincount((base + code).ravel(), dx[side].ravel(), size[0] * size[1]).reshape(size)
            dh = dh * z + np.matmul(u.transpose(0, 2, 1), dg)
        return loss, d

    def fit(self, codes: np.ndarray, truth: np.ndarray, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> BiGru:
        """Adam over shuffled batches; codes (N, T), truth (N). The same input gives the same weights."""
        rng = np.random.default_rng(seed)
        adam = _Adam(self.p)
        batch = max(16, min(batch, len(codes) // 8))
        rounds = max(rounds, -(-LEAST_UPDATES * batch // max(1, len(codes))))
        for turn in range(rounds):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                _, d = self.gradients(np.ascontiguousarray(codes[pick].T), truth[pick])
                adam.step(d, rate * (1 - turn / rounds) ** 0.5)
        return self

    def follow(self, texts: Iterator[tuple[int, bytes]], codes: np.ndarray, truth: np.ndarray, rate: float = STREAM_RATE, seed: int = 13) -> int:
        """Adam over every piece of (language, text), once if there are many; returns the number of pieces.

        Every batch takes AGAIN pieces of codes (N, T) and truth (N), each language as often, and the languages in a
        batch count alike. Twice POOL pieces and one text are held at most.
        """
        width, rng, adam, seen = codes.shape[1], np.random.default_rng(seed), _Adam(self.p), 0
        share = 1.0 / np.bincount(truth, minlength=len(self.langs))[truth]
        upto = np.cumsum(share) / share.sum()
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        waiting = 0

        def flush(all_: bool, turns: int = 1) -> None:
            nonlocal waiting, seen
            pool, who = np.concatenate(held), np.concatenate(owners)
            done = waiting if all_ else waiting // STREAM * STREAM
            for _ in range(turns):
                order = rng.permutation(waiting)
                pool, who = pool[order], who[order]
                for at in range(0, done, STREAM):
                    again = np.minimum(np.searchsorted(upto, rng.random(AGAIN)), len(truth) - 1)
                    langs = np.concatenate([who[at : min(done, at + STREAM)], truth[again]])
                    batch = np.concatenate([pool[at : min(done, at + STREAM)], codes[again]])
                    counts = np.bincount(langs, minlength=len(self.langs))
                    _, d = self.gradients(np.ascontiguousarray(batch.T), langs, len(langs) / np.count_nonzero(counts) / counts[langs])
                    adam.step(d, rate / (1 + adam.steps / 100) ** 0.5)
            held[:], owners[:] = [pool[done:]], [who[done:]]
            seen, waiting = seen + done, waiting - done

        for lang, text in texts:
            for at in range(0, len(text), width * POOL):
                part = pieced(text[at : at + width * POOL], width)
                held.append(part)
                owners.append(np.full(len(part), lang))
                waiting += len(part)
                if waiting >= POOL:
                    flush(False)
        if waiting:
            flush(True, 1 if seen else -(-LEAST_STEPS // -(-waiting // STREAM)))
        return seen

    def pooled(self, texts: list[bytes], width: int = PIECE, block: int = BLOCK) -> np.ndarray:
        """(documents, L): the mean of the probabilities of all positions of each text; uniform for an empty one.

        Pieces of all texts go through side by side, ``block`` at a time, so a long text costs time and no memory.
        """
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        owners: list[np.ndarray] = []
        held: list[np.ndarray] = []
        waiting = 0

        def flush(all_: bool) -> None:
            nonlocal waiting
            codes, who = np.concatenate(held), np.concatenate(owners)
            done = len(codes) if all_ else len(codes) // block * block
            for at in range(0, done, block):
                part, of = np.ascontiguousarray(codes[at : min(done, at + block)].T), who[at : min(done, at + block)]
                prob = self.label(self.run(part))
                mask = part != PAD
                sums = np.einsum("tlb,tb->lb", prob, mask.astype(np.float32))
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(of, sums[k], len(texts))
                count[:] += np.bincount(of, mask.sum(axis=0), len(texts))
            held[:], owners[:] = [codes[done:]], [who[done:]]
            waiting = len(codes) - done

        for i, text in enumerate(texts):
            for at in range(0, len(text), width * block):
                codes = pieced(text[at : at + width * block], width)
                held.append(codes)
                owners.append(np.full(len(codes), i))
                waiting += len(codes)
                if waiting >= block:
                    flush(False)
        if waiting:
            flush(True)
        return (total + 1e-9) / (total + 1e-9).sum(axis=1, keepdims=True)


def pieced(text: bytes, width: int = PIECE) -> np.ndarray:
    """(pieces, width): the whole text, filled up with PAD."""
    codes = np.full(-(-len(text) // width) * width, PAD, np.int16)
    codes[: len(text)] = np.frombuffer(text, np.uint8)
    return codes.reshape(-1, width)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, out: bool) -> DataFrame:
    """i, lang, t: every row with an id, a language and a text that isn't empty; out: of the held-out ones."""
    rows = docs.select(col(id_col).alias("i"), col(lang_col).cast("string").alias("lang"), col(text_col).alias("t"))
    return rows.filter(F.col("i").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("t") > 0) & (held_out(F.col("i")) == F.lit(out)))


def least_score(model: BiGru, docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> float:
    """The score below which a text counts as being in none of the languages.

    Midway between an even guess and what 99 of 100 of all held-out labelled documents with a letter reach, rounded down
    to a SCORE_BINS-th, by their whole texts; an even guess, which rejects nothing, where there is none. Rows of one id
    and language count as one, by their least score.
    """
    even = 1.0 / len(model.langs)
    rows = spread(_labelled(docs, id_col, text_col, lang_col, True).filter(_lettered(F.col("t"))))
    scored = rows.select("i", "lang", said(docs.sparkSession, model, F.col("t")).alias("s"))  # a filter by s would run the network twice
    each = scored.groupBy("i", "lang").agg(F.min("s.score").alias("score"))
    bins = each.groupBy(F.floor(F.col("score") * SCORE_BINS).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()  # SCORE_BINS + 1 rows at most
    below, total = 0, sum(r["n"] for r in bins)
    for r in bins:
        below += r["n"]
        if 100 * below > total:
            return even + max(0.0, r["bin"] / SCORE_BINS - even) / 2
    return even


#: How many times the ids wanted are looked at where a language has more; the rest lie above a bound on the hash.
SPARE = 3


def _least(known: DataFrame, per_lang: int, shares: dict[str, float]) -> DataFrame:
    """__i, lang: the ``per_lang`` ids with the least hashes of each language, each once.

    Only ids in the least share of the hashes of their language are shuffled and ranked, so what one task ranks doesn't
    grow with the documents. Shares come from estimates; should too few ids lie within one, all ids are ranked.
    """
    bound = {lang: (1 << 63) - 1 if share >= 1 else int(share * 2.0**64) - (1 << 63) for lang, share in shares.items()}
    bounds = known.sparkSession.createDataFrame(list(bound.items()), "lang string, b long")
    hashed = known.withColumn("h", F.xxhash64("i", "lang"))

    def ranked(rows: DataFrame) -> DataFrame:
        order = W.partitionBy("lang").orderBy("h", "i")
        numbered = rows.select("i", "lang", "h").distinct().withColumn("n", F.row_number().over(order))
        return settle(numbered.filter(F.col("n") <= per_lang).select(F.col("i").alias("__i"), "lang"))

    chosen = ranked(hashed.join(F.broadcast(bounds), "lang").filter("h <= b"))  # a row a language
    cut = [lang for lang, share in shares.items() if share < 1]
    held = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()} if cut else {}
    return ranked(hashed) if any(held.get(lang, 0) < per_lang for lang in cut) else chosen


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = SAMPLE_DOCS, pieces: int = SAMPLE_PIECES, every: int = SAMPLE_ALL) -> list[tuple[str, bytes]]:
    """(lang, piece) of a bounded sample of labelled documents that are not held out, of all their languages.

    The ids with the least hash of each language come from scans without texts, cut to ``per_lang`` a language before
    they are shuffled; then the texts of those alone are read, and ``pieces`` evenly spaced pieces of each are sent.
    Rows of one id and language count as one, the one whose pieces come first, however many there are.
    """
    lang = col(lang_col).cast("string").alias("lang")
    known = docs.select(col(id_col).alias("i"), lang).filter(F.col("lang").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    sizes = {r["lang"]: r["d"] for r in known.groupBy("lang").agg(F.approx_count_distinct("i").alias("d")).collect()}  # a row a language
    if not sizes:
        return []
    per_lang = min(per_lang, max(LEAST_DOCS, every // len(sizes)))
    chosen = _least(known, per_lang, {lang: 1.0 if d <= SPARE * per_lang else SPARE * per_lang / d for lang, d in sizes.items()})
    size = F.length("t")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substring("t", F.floor(k * size / F.lit(pieces)).cast("int") + 1, F.lit(PIECE)))
    rows = docs.select(col(id_col).alias("__i"), lang, F.encode(col(text_col), "utf-8").alias("t")).filter("t is not null and lang is not null")
    held = rows.join(F.broadcast(chosen), ["__i", "lang"])  # per_lang * langs rows
    got = held.groupBy("__i", "lang").agg(F.min(F.array_distinct(cuts)).alias("p")).orderBy("__i", "lang").collect()
    return [(r["lang"], bytes(p)) for r in got for p in r["p"] if p]


def train(labelled: list[tuple[str, bytes]], width: int = PIECE, **options) -> BiGru | None:
    """The network for the languages of the labelled pieces; none of them gives none."""
    if not labelled:
        return None
    langs = sorted({lang for lang, _ in labelled})
    return BiGru.fresh(langs).fit(*_coded(labelled, langs, width), **options)


def _coded(labelled: list[tuple[str, bytes]], langs: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as codes (N, T), and truth (N): the places of their languages."""
    codes = np.full((len(labelled), width), PAD, np.int16)
    for i, (_, piece) in enumerate(labelled):
        codes[i, : len(piece[:width])] = np.frombuffer(piece[:width], np.uint8)
    at = {lang: k for k, lang in enumerate(langs)}
    return codes, np.array([at[lang] for lang, _ in labelled])


def chunks(rows: DataFrame) -> DataFrame:
    """rows with n and b: every byte of the texts b in order, in rows of CHUNK bytes at most, n from 0; empty texts have none."""
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(b) - 1) / CHUNK).cast("int")), lambda k: F.substring(b, k * CHUNK + 1, F.lit(CHUNK)))
    whole = F.array(F.col("b"))  # encodes each text once
    others = [c for c in rows.columns if c != "b"]
    return rows.filter(F.octet_length("b") > 0).select(*others, F.posexplode(F.flatten(F.transform(whole, cut))).alias("n", "b"))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> BiGru | None:
    """The network learned from every byte of every labelled document that is not held out; none of them gives none.

    A bounded sample only sets the weights to begin with. From there all rows are dealt to lanes, whose number follows
    from their bytes, by a hash of id, place and bytes, which is also their order in the lane. A task follows each lane
    (BiGru.follow), and the weights are the mean over lanes by pieces, summed exactly. So they depend on the rows alone: not on
    files, cores or the order in which tasks end, and a lane that is run again gives the same. Every language with a text
    is learned, each row counts, and copies under other ids spread over the lanes.
    """
    rows = _labelled(docs, id_col, text_col, lang_col, False)
    first = sample(docs, id_col, text_col, lang_col)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("t")).alias("n")).collect()}  # a row a language
    missing = set(sizes) - {lang for lang, _ in first}
    if missing:  # a language of which the sample has empty texts only
        first += sample(rows.filter(F.col("lang").isin(*missing)), "i", "t", "lang")
    model = train(first)
    if model is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.p, *_coded(first, model.langs, PIECE)))

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p, codes, truth = shared.value
        at = {lang: k for k, lang in enumerate(langs)}
        net = BiGru(langs, {k: x.copy() for k, x in p.items()})
        seen = net.follow(((at[lang], part) for rows in batches for lang, part in zip(rows["lang"].to_pylist(), rows["b"].to_pylist(), strict=True)), codes, truth)
        if seen:
            flat = np.concatenate([x.ravel() for x in net.p.values()]).astype(np.float64)
            sums = np.concatenate([[seen], np.rint(flat * seen * UNIT)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat), dtype=np.int32)), pa.array(sums)], ["i", "v"])

    dealt = chunks(rows.select("i", "lang", F.encode("t", "utf-8").alias("b"))).select("lang", "b", F.xxhash64("i", "n", "b").alias("h"))
    lanes = max(1, min(MOST_LANES, -(-sum(sizes.values()) // LANE)))
    parts = dealt.repartition(lanes, "h").sortWithinPartitions("h", "lang", "b").select("lang", "b").mapInArrow(followed, "i int, v long")
    sums = {r["i"]: r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect()}  # a row a weight
    if not sums:
        return model
    flat, at = np.array([sums[i] for i in range(len(sums) - 1)]) / (sums[-1] * float(UNIT)), 0
    for k, x in model.p.items():
        model.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return model


def _lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def said(spark: SparkSession, model: BiGru | None, text: Column) -> Column:
    """struct<lang_pred: string, score: double> of a text; see identify()."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown
    shared = spark.sparkContext.broadcast((model.langs, model.p))

    @F.arrow_udf("lang_pred string, score double")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = BiGru(*shared.value)
        for texts in batches:
            prob = np.concatenate([np.zeros((0, len(net.langs))), *(net.pooled([x or b"" for x in some]) for some in few(texts))])
            langs = pa.array([net.langs[k] for k in prob.argmax(axis=1)], pa.string())
            yield pa.StructArray.from_arrays([langs, pa.array(np.minimum(prob.max(axis=1), 1.0))], ["lang_pred", "score"])

    return F.when(_lettered(text), guess(text)).otherwise(unknown)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on a sample of docs and predict all of docs: doc_id, held_out, lang_pred, score.

    Texts that are null or have no letter are ``und`` with score 0, and so is everything when no document is
    labelled. Every byte of a text of any length counts. Prediction sees the text alone: rows with equal texts get
    equal answers, whatever their other columns. Repeated rows and null ids stay. An empty table gives an empty one.
    """
    model = train(sample(docs, id_col, text_col, lang_col))
    rows = spread(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("t")))
    rows = rows.select("doc_id", said(docs.sparkSession, model, F.col("t")).alias("s"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.lang_pred", "s.score")
