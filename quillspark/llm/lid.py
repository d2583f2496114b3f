"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network runs over all bytes of a text, WINDOW bytes at a time: its states start anew at the ends of a window, which
bounds its memory and lets many windows run side by side. Every byte position gets probabilities over the languages; a
text's are their mean over all its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.bpe import release, slices
from quillspark.llm.common import bounded_batches, table

#: Bytes of a window.
WINDOW = 256
HIDDEN = 8
#: The training sample: at most this many documents of a language, each with its whole text.
DOCS_PER_LANG = 300
STEPS, BATCH, RATE, SEED = 300, 256, 0.03, 7
#: Bytes of the windows that are trained on, drawn from anywhere in the sample's texts.
LENGTHS = (8, 24, 64)
#: Windows that run side by side, and bytes of the texts whose windows are dealt out together.
SIDE_BY_SIDE, SLICE_BYTES = 1024, 4 << 20
#: A text whose best mean probability is lower than this is rejected by the pipeline stage.
REJECT_BELOW = 0.3


def _softsign(v: np.ndarray) -> np.ndarray:
    return v / (1 + np.abs(v))


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    p = np.exp(logits - logits.max(axis, keepdims=True))
    return p / p.sum(axis, keepdims=True)


class Network:
    """Two gated recurrent units, one in each direction, and a softmax over the languages at every position.

    A unit's state h takes in byte x as h + z (c - h), with gates r, z = (1 + s(X x + U h)) / 2 and the candidate
    c = s(X x + r (U h)), where s(v) = v / (1 + |v|), the softsign, stands for the usual tanh at a fraction of its cost.
    The first axis of the weights is the direction, the rows are r, z and the candidate.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
        self.w = {"x": draw(2, 3 * hidden, 256), "u": draw(2, 3 * hidden, hidden), "o": draw(2, len(languages), hidden), "b": np.zeros((len(languages), 1), dtype=np.float32)}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of the windows in the columns of ``x``, and its gradient by backpropagation through time."""
        n, w = self.hidden, self.w
        both = np.stack((x, x[::-1]), axis=1)  # time, direction, window
        h, steps = np.zeros((2, n, x.shape[1]), dtype=w["u"].dtype), []
        for now in both:
            g = np.stack((w["x"][0][:, now[0]], w["x"][1][:, now[1]]))
            p = w["u"] @ h
            gates = (1 + _softsign(g[:, : 2 * n] + p[:, : 2 * n])) / 2
            r, z = gates[:, :n], gates[:, n:]
            c = _softsign(g[:, 2 * n :] + r * p[:, 2 * n :])
            steps.append((h, r, z, p[:, 2 * n :], c))
            h = h + z * (c - h)
        after = np.stack([s[0] for s in steps[1:]] + [h])  # time, direction, hidden, window
        logits = w["o"][0] @ after[:, 0] + w["o"][1] @ after[::-1, 1] + w["b"]
        p = _softmax(logits, 1)
        hit = np.take_along_axis(p, y[None, None, :], 1)
        loss = -float(np.mean(np.log(hit + 1e-9)))
        delta = p.copy()
        np.put_along_axis(delta, y[None, None, :], hit - 1, 1)
        delta /= x.size
        grad = {
            "b": delta.sum((0, 2))[:, None],
            "o": np.stack((np.einsum("tkb,thb->kh", delta, after[:, 0]), np.einsum("tkb,thb->kh", delta, after[::-1, 1]))),
            "u": np.zeros_like(w["u"]),
        }
        into = np.stack((w["o"][0].T @ delta, (w["o"][1].T @ delta)[::-1]), axis=1)
        back, taken = np.zeros_like(h), []
        for t in range(len(x) - 1, -1, -1):
            h, r, z, u, c = steps[t]
            back = back + into[t]
            dc = back * z * (1 - np.abs(c)) ** 2
            dr, dz = dc * u * (1 - np.abs(2 * r - 1)) ** 2 / 2, back * (c - h) * (1 - np.abs(2 * z - 1)) ** 2 / 2
            gates = np.concatenate((dr, dz, dc * r), axis=1)
            grad["u"] += gates @ h.transpose(0, 2, 1)
            taken.append(np.concatenate((dr, dz, dc), axis=1))
            back = back * (1 - z) + w["u"].transpose(0, 2, 1) @ gates
        taken = np.stack(taken[::-1])  # time, direction, gate, window
        grad["x"] = np.stack([[np.bincount(both[:, d].reshape(-1), taken[:, d, j].reshape(-1), 256) for j in range(3 * n)] for d in (0, 1)]).astype(h.dtype)
        return loss, grad

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over windows drawn from all places of ``texts``, languages equally often; returns the last loss."""
        rng = np.random.default_rng(seed)
        pad = max(LENGTHS)
        data = np.frombuffer(b"".join(t + b" " * max(0, pad - len(t)) for t in texts), dtype=np.uint8)
        sizes = np.array([max(len(t), pad) for t in texts])
        starts = np.cumsum(sizes) - sizes
        of = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        share = [np.cumsum(sizes[rows]) for rows in of]
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            length = LENGTHS[step % len(LENGTHS)]
            label = np.arange(batch) % len(of)
            row = np.array([of[k][np.searchsorted(share[k], rng.integers(share[k][-1]), side="right")] for k in label])
            at = starts[row] + rng.integers(0, sizes[row] - length + 1)
            loss, grad = self.gradients(data[at + np.arange(length)[:, None]], label)
            norm = np.sqrt(sum(float(np.sum(g * g)) for g in grad.values()))
            now = rate * (1 - 0.9 * step / steps) * min(1.0, 1.0 / (norm + 1e-9))
            for k, g in grad.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g * min(1.0, 1.0 / (norm * norm + 1e-9)) - square[k])
                self.w[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
        return loss

    def sums(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over the positions of each window of ``data`` of the languages' probabilities: (window, language).

        ``lengths`` must not increase: after a window's end the windows before it go on alone. Before the first and
        after the last window ``data`` has WINDOW bytes more.
        """
        n, count, steps = self.hidden, len(starts), int(lengths[0])
        wx = [[np.ascontiguousarray(self.w["x"][d, k * n : (k + 1) * n].T) for k in range(3)] for d in (0, 1)]
        wu = [np.ascontiguousarray(self.w["u"][:, k * n : (k + 1) * n].transpose(0, 2, 1)) for k in range(3)]
        live = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()  # windows longer than t
        near = np.lib.stride_tricks.sliding_window_view(data, steps)
        x = np.stack((near[starts], near[starts + lengths - steps][:, ::-1])).transpose(0, 2, 1)
        x = np.ascontiguousarray(x)  # direction, time, window
        h = np.zeros((2, count, n), dtype=np.float32)
        logits = np.zeros((2, steps, len(self.languages), count), dtype=np.float32)
        room = [np.empty((2, count, n), dtype=np.float32) for _ in range(4)]
        m = -1
        for t in range(steps):
            if live[t] != m:
                m = live[t]
                now = h[:, :m]
                g, p, size, r = (v[:, :m] for v in room) if m < count else room

            def pre(k: int, out: np.ndarray) -> None:
                """The gate's input from the byte; its other input is left in ``p``."""
                for d in (0, 1):
                    np.take(wx[d][k], x[d, t, :m], axis=0, out=out[d], mode="clip")
                np.matmul(now, wu[k], out=p)

            def soft(v: np.ndarray) -> None:
                np.abs(v, out=size)
                np.add(size, 1, out=size)
                np.divide(v, size, out=v)

            pre(0, r)
            r += p
            soft(r)
            r += 1
            r *= 0.5
            pre(2, g)
            p *= r
            g += p  # the candidate
            soft(g)
            g -= now
            pre(1, r)
            r += p
            soft(r)
            r += 1
            r *= 0.5
            g *= r
            now += g
            np.matmul(self.w["o"], now.transpose(0, 2, 1), out=logits[:, t, :, :m])
        back = lengths - 1 - np.arange(steps)[:, None]  # the backward unit's step at each position
        inside = back >= 0
        if inside.all():
            p = logits[0] + logits[1][::-1]
        else:
            p = logits[0] + np.take_along_axis(logits[1], np.where(inside, back, 0)[:, None, :], 0)
        p += self.w["b"]
        p = _softmax(p, 1)
        p *= inside[:, None, :]
        return p.sum(0).T

    def text_means(self, texts: pa.Array) -> np.ndarray:
        """Mean probabilities over all bytes of each text: (text, language); those of an empty text are 0."""
        margin = b" " * WINDOW
        data = np.frombuffer(margin + (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes() + margin, dtype=np.uint8)
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        sizes = np.diff(ends)
        n = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        starts = ends[text] + (nth + 1) * WINDOW
        lengths = np.minimum(sizes[text] - nth * WINDOW, WINDOW)
        order = np.argsort(-lengths, kind="stable")
        total = np.zeros((len(sizes), len(self.languages)))
        for at in range(0, len(order), SIDE_BY_SIDE):
            rows = order[at : at + SIDE_BY_SIDE]
            np.add.at(total, text[rows], self.sums(data, starts[rows], lengths[rows]))
        return total / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> list[tuple[str, str]]:
    """(lang, text) of at most ``per_lang`` documents of each language, chosen by a hash of their ids: the bounded
    sample of labelled rows that the network is fitted to. Texts are whole."""
    # ids first: the texts of the chosen rows only are read and sent
    keyed = docs.where("lang is not null and text is not null and doc_id is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = [r["doc_id"] for r in keyed.withColumn("r", rank).where(F.col("r") <= per_lang).select("doc_id").collect()]
    chosen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isin(ids))
    rows = chosen.select("lang", "doc_id", "text").collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"]))]


def train(sample: list[tuple[str, str]], **options) -> Network | None:
    """A network for the sample's languages; None where the sample has none."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    net = Network(languages)
    if len(languages) > 1:
        net.fit([t.encode() for _, t in sample], np.array([languages.index(lang) for lang, _ in sample]), **options)
    return net


def _judge(net: Network | None):
    kind = "lang_pred string, score double"

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for texts in batches:
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            for a, b in slices(texts, SLICE_BYTES) if net is not None else ():
                part = texts.slice(a, b - a)
                some = pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False)
                p = net.text_means(pa.concat_arrays([pc.if_else(some, part, "")]))
                best, some = p.argmax(1), some.to_numpy(zero_copy_only=False)
                lang[a:b] = np.where(some, np.array(net.languages, dtype=object)[best], "und")
                score[a:b] = np.where(some, np.clip(p[np.arange(b - a), best], 0, 1), 0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    judged.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judged, kind)


def judgement(text: Column, net: Network | None) -> Column:
    """Struct (lang_pred string, score double) of a text column; only the texts go to Python."""
    return _judge(net)(text)


def predict(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred string and score double; the whole text is read.

    A null text, one without a letter, and any text where no language was learned: ``und`` and 0. Only the text
    decides; rows are handled one by one, so repeated rows get equal answers; an empty table gives no rows. Columns
    of the input named lang_pred or score stand before the answers of that name.
    """
    bounded_batches(docs.sparkSession)
    # names of its own until the end, so that none clashes
    judged = docs.select(*[F.col(k).alias(f"_{k}") for k in keep], judgement(F.col("text"), net).alias("answer"))
    return judged.select(*[F.col(f"_{k}").alias(k) for k in keep], "answer.lang_pred", "answer.score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 3 is not 1. Cases as in ``predict``; a null
    doc_id is not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = docs.withColumn("held_out", F.coalesce(held, F.lit(False)))
    net = train(training_sample(docs.where(~F.col("held_out"))))
    return predict(docs, net, ["doc_id", "held_out"])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keeps the rows of ``docs`` whose text has a language.

    Rejected are null texts, texts without a letter and texts for which no language reaches REJECT_BELOW.
    Rows and columns of those kept stay as they are.
    """
    bounded_batches(spark)
    answer = judgement(F.col("text"), train(training_sample(docs)))
    return docs.where((answer["lang_pred"] != "und") & (answer["score"] >= REJECT_BELOW))
