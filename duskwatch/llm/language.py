"""Language of a text by cross-parsing: the language whose sample says it in the fewest phrases."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import pieces, scratch, settled
from duskwatch.llm.jaccard import small_side

#: Bytes that stand for themselves: letters and all beyond ASCII; whatever else stands between them is one blank.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Symbols that are parsed as one run. A long text is many runs; a phrase ends where its run does.
RUN = 512
#: Runs that advance together.
LANES = 4096
#: Symbols of each language's sample, of all samples together, and taken from one document of it.
SAMPLE_SYMBOLS, ALL_SYMBOLS, SYMBOLS_OF_DOCUMENT = 1 << 15, 1 << 18, 1000
#: Documents of each language that the sample is taken from, at most.
SAMPLE_DOCUMENTS = 200


def normalised(text: str) -> bytes:
    """Small letters with single blanks between and around words, as UTF-8; nothing for a text without them."""
    words = text.lower().encode().translate(LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Automaton:
    """The suffix automaton of a sample: from the root, every substring of it and nothing else can be read.

    ``moves`` holds for each state and code the number of the next state times the number of codes, 0 where there is
    none. State 1 reads nothing: a phrase ends there at once. Codes number the bytes of the sample from 1; 0 is any other byte.
    """

    def __init__(self, sample: bytes):
        import numpy as np

        self.size = len(sample)
        used = sorted(set(sample))
        self.codes = np.zeros(256, dtype=np.uint8)
        self.codes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for code in self.codes[np.frombuffer(sample, dtype=np.uint8)].tolist():
            state = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and code not in moves[at]:
                moves[at][code] = state
                at = link[at]
            if at >= 0:
                to = moves[at][code]
                if length[at] + 1 == length[to]:
                    link[state] = to
                else:
                    copy = len(moves)
                    moves.append(dict(moves[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and moves[at].get(code) == to:
                        moves[at][code] = copy
                        at = link[at]
                    link[to] = link[state] = copy
            last = state
        table = np.zeros((len(moves) + 2, width), dtype=np.int32)  # 0 unused, 1 reads nothing, the rest from 2
        for state, found in enumerate(moves):
            for code, to in found.items():
                table[state + 2, code] = (to + 2) * width
        self.moves, self.width = table.reshape(-1), width
        self.begin = np.where(table[2] > 0, table[2], width).astype(np.int32)

    def phrases(self, runs, lengths):
        """How many phrases each run needs: the longest beginning that the sample holds, and so on with the rest.

        ``runs``: one column a run, the longest ones first; ``lengths``: how long they are. All runs advance together.
        A byte that the sample does not hold is a phrase by itself.
        """
        import numpy as np

        count = np.zeros(runs.shape[1], dtype=np.int64)
        state = np.full(runs.shape[1], self.width, dtype=np.int32)
        active = runs.shape[1]
        codes = self.codes[runs]
        for step in range(runs.shape[0]):
            while active and lengths[active - 1] <= step:
                active -= 1
            code = codes[step, :active]
            to = self.moves[state[:active] + code]
            over = to == 0
            count[:active] += over
            state[:active] = np.where(over, self.begin[code], to)
        return count


@dataclass(frozen=True)
class Model:
    """One sample of text per language; small enough to travel with a task."""

    samples: tuple[tuple[str, bytes], ...]

    def automata(self) -> list[Automaton]:
        if self.samples not in _BUILT:
            _BUILT.clear()
            _BUILT[self.samples] = [Automaton(sample) for _, sample in self.samples]
        return _BUILT[self.samples]


_BUILT: dict[tuple, list[Automaton]] = {}  # of the model this Python worker used last


def cut(texts: list[bytes]):
    """Blocks of (runs as columns, their lengths, the text each belongs to), the longest runs first."""
    import numpy as np

    owner, lengths, starts, at = [], [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text), RUN):
            owner.append(i)
            starts.append(at + start)
            lengths.append(min(RUN, len(text) - start))
        at += len(text)
    flat = np.frombuffer(b"".join(texts) + bytes(RUN), dtype=np.uint8)
    owner, starts, lengths = (np.array(x, dtype=np.int64) for x in (owner, starts, lengths))
    order = np.argsort(-lengths, kind="stable")
    for lo in range(0, len(order), LANES):
        own = order[lo : lo + LANES]
        yield flat[starts[own][None, :] + np.arange(lengths[own[0]])[:, None]], lengths[own], owner[own]


def identify(texts: list[str | None], model: Model) -> list[tuple[str, float, int, int]]:
    """(language, score, phrases, symbols) of every text.

    A language's cost is its phrases times the logarithm of its sample's size, the bits that name a phrase's place in the sample.
    The least cost wins, of equal ones the language that sorts first. The score is how far the next language's cost is above it: 0 for a tie, towards 1 the farther.
    """
    import numpy as np

    plain = [normalised(t) if t and has_letter(t) else b"" for t in texts]
    out: list[tuple[str, float, int, int]] = [("und", 0.0, 0, len(p)) for p in plain]
    if not model.samples or not any(plain):
        return out
    counts = np.zeros((len(model.samples), len(texts)), dtype=np.int64)
    for runs, lengths, owner in cut(plain):
        for i, automaton in enumerate(model.automata()):
            np.add.at(counts[i], owner, automaton.phrases(runs, lengths))
    bits = np.array([log2(max(2, len(sample))) for _, sample in model.samples])
    costs = counts * bits[:, None]
    for i, p in enumerate(plain):
        if not p:
            continue
        best = int(costs[:, i].argmin())
        rest = np.delete(costs[:, i], best)
        score = 1.0 - costs[best, i] / rest.min() if len(rest) else 1.0
        out[i] = (model.samples[best][0], float(min(max(score, 0.0), 1.0)), int(counts[best, i]), len(p))
    return out


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None) -> Model:
    """A sample of every language, from at most ``SAMPLE_DOCUMENTS`` of its documents and ``SAMPLE_SYMBOLS`` symbols long.

    Documents are taken in the order of a hash (``order``; default: of the text), ``SYMBOLS_OF_DOCUMENT`` symbols from
    each, until the sample is full. Only the choice of this sample is bounded; what is parsed is never cut. With very many
    languages the samples are shorter: together they hold ``ALL_SYMBOLS`` at most.
    """
    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), (F.xxhash64(text) if order is None else order).alias("h"), F.col(text).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # Numbers are ranked without their texts; only the chosen texts, cut to what a sample takes, go on.
    cut_text = F.substring("text", 1, 4 * SYMBOLS_OF_DOCUMENT)
    with scratch(rows.sparkSession):
        numbers = labelled.select("lang", "h").withColumn("n", place).filter(F.col("n") <= SAMPLE_DOCUMENTS)
        numbers = settled(numbers.select("lang", "h").distinct(), "sample-documents")
        chosen = labelled.join(small_side(numbers), ["lang", "h"]).select("lang", "h", cut_text.alias("text"))
        texts = _sample_texts(chosen)
    limit = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(len(texts), 1))
    samples = []
    for name, found in sorted(texts.items()):
        sample = b""
        for t in dict.fromkeys(found):
            if len(sample) >= limit:
                break
            sample += normalised(t)[:SYMBOLS_OF_DOCUMENT]
        if sample := sample[:limit]:
            samples.append((name, sample))
    return Model(tuple(samples))


def _sample_texts(chosen: DataFrame) -> dict[str, list[str]]:
    chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("n") <= SAMPLE_DOCUMENTS)
    texts: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.n)):
        texts.setdefault(r.lang, []).append(r.text)
    return texts


def identify_language(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the language of its whole text, and how sure that is (0 to 1).

    ``und`` with score 0 for a null text, for one without a letter, and for all texts where no language was learned. Long texts
    are parsed in runs of 512 bytes. Repeated rows each get their row; an empty table gives none.
    """
    names = [key, *keep]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in pieces(whole, len(names)):
                found = identify(batch.column(len(names)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i) for i in range(len(names))),
                        pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                        pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()),
                    ],
                    names=[*names, "lang_pred", "score", "phrases", "symbols"],
                )

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, text).mapInArrow(run, f"{kinds}, lang_pred string, score double, phrases bigint, symbols bigint")
