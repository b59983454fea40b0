"""Models as batch backends.

A backend is a function from a pandas frame to a pandas frame of the same rows
with further columns (engines: of any rows); a model is loaded once a worker.
The ones here need no model: they make plans runnable and tests repeatable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .functions import tables as T
from .sources.storage import bounded_batches

#: Frames in, frames out.
Batches = Iterator[pd.DataFrame]
Backend = Callable[[Batches], Batches]
#: One frame in, one frame out.
Step = Callable[[pd.DataFrame], pd.DataFrame]
_LOADED: dict[tuple, object] = {}


def loaded(key: tuple, load: Callable[[], object]):
    """What load made for key in this worker, made once."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def run(df: DataFrame, backend: Backend, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInPandas(backend, schema)


def batches(*steps: Step) -> Backend:
    """Steps one after another on each batch."""

    def f(frames: Batches) -> Batches:
        for b in frames:
            for step in steps:
                b = step(b)
            yield b

    return f


def guarded(each: Callable[[pd.Series], object], column: str, default=None) -> Backend:
    """Adds column by each row, and error where that failed: one row's failure is not the job's."""

    def step(b: pd.DataFrame) -> pd.DataFrame:
        values, errors = [], []
        for row in b.to_dict("records"):
            try:
                values.append(each(row))
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                values.append(default)
                errors.append(f"{type(e).__name__}: {e}")
        return b.assign(**{column: values, "error": errors})

    return batches(step)


def _characters(x: object) -> int:
    """Of all texts of an input or an answer; anything else counts as eight."""
    return len(x) if isinstance(x, str) else sum(map(_characters, x)) if isinstance(x, (tuple, list)) else 8


class Asked:
    """Answers of a model to many inputs: each different input is asked once a task, in batches of about equally long ones, as long as its answer is kept.

    ask takes a list of inputs and returns as many answers.  A batch that fails
    is asked again by halves, so one input's failure is told with that input
    alone.  most: answers that are kept; room: characters of inputs and answers that are.
    """

    def __init__(self, ask: Callable[[list], list], size: int = 8, most: int = 100_000, room: int = 4_000_000):
        self.ask, self.size, self.most, self.room = ask, size, most, room
        self.kept: dict = {}

    def _solve(self, part: list, out: dict) -> None:
        try:
            answers = list(self.ask(part))
            if len(answers) != len(part):
                raise ValueError(f"{len(answers)} answers to {len(part)} inputs")
            out.update((x, (y, None)) for x, y in zip(part, answers, strict=True))
        except Exception as e:  # noqa: BLE001
            if len(part) == 1:
                out[part[0]] = (None, f"{type(e).__name__}: {e}")
                return
            self._solve(part[: len(part) // 2], out)
            self._solve(part[len(part) // 2 :], out)

    def __call__(self, inputs: list) -> list[tuple[object, str | None]]:
        """(answer, error) of each input; inputs are texts or tuples of texts, null ones get (None, None)."""
        new = [x for x in dict.fromkeys(inputs) if x is not None and x not in self.kept]
        new.sort(key=lambda x: len(x) if isinstance(x, str) else sum(len(y or "") for y in x))
        out: dict = {}
        for a in range(0, len(new), self.size):
            self._solve(new[a : a + self.size], out)
        found = [(None, None) if x is None else self.kept.get(x) or out[x] for x in inputs]
        for x, answer in out.items():
            if len(self.kept) < self.most and answer[1] is None and (size := _characters((x, answer))) <= self.room:
                self.kept[x] = answer
                self.room -= size
        return found


def first_that_works(named: dict[str, Step]) -> Step:
    """The first step that raises nothing, with its name in column engine; the last one's error passes on."""

    def step(b: pd.DataFrame) -> pd.DataFrame:
        for k, (name, f) in enumerate(named.items()):
            try:
                return f(b).assign(engine=name)
            except Exception:  # noqa: BLE001
                if k + 1 == len(named):
                    raise
        raise ValueError("no engine")

    return step


def kept_once(ask: Callable[[str], str | None], most: int = 100_000) -> Callable[[str], str]:
    """ask for each word once a worker; a word whose answer fails or is empty stays as it is."""
    kept: dict[str, str] = {}

    def one(word: str) -> str:
        found = kept.get(word)
        if found is None:
            try:
                found = ask(word) or word
            except Exception:  # noqa: BLE001
                found = word
            if len(kept) < most:
                kept[word] = found
        return found

    return one


def identity_engine(text: str, engine: str, beams: int = 2, samples: int = 2) -> list[tuple[str, str, float | None]]:
    """(text, method, score) of an engine that returns its input: beams first, with scores, then samples without; repeats go."""
    out, seen = [], set()
    for k in range(beams + samples):
        candidate = text if k == 0 else f"{text} {engine}"
        if candidate not in seen:
            seen.add(candidate)
            out.append((candidate, "beam", -float(k + len(engine))) if k < beams else (candidate, "sample", None))
    return out


def with_tags(engine: Callable[..., list[tuple[str, str, float | None]]], direction: str) -> Callable[..., list[tuple[str, str, float | None]]]:
    """An engine that is given its codes of both languages before the text, and whose texts lose what models leave behind."""
    languages = {"bn2en": ("bn", "en"), "en2bn": ("en", "bn")}[direction]

    def f(text: str, name: str) -> list[tuple[str, str, float | None]]:
        codes = T.ENGINE_CODES[name]
        out = []
        for found, method, score in engine(" ".join([*(codes[x] for x in languages), text]), name):
            for mark in T.ARTIFACTS:
                found = found.replace(mark, "")
            out.append((" ".join(found.split()), method, score))
        return out

    return f


def same_text(text: str, engine: str, direction: str) -> str:  # noqa: ARG001
    """A round trip that returns its input."""
    return text


def word_overlap(a: str, b: str) -> float:
    """Share of a's distinct words that b has; 1.0 if a has none."""
    words = set(a.split())
    return len(words & set(b.split())) / len(words) if words else 1.0


def script_language(text: str) -> tuple[str | None, float]:
    """The language of most letters by script alone, Bengali or else English, and their share of all letters."""
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return None, 0.0
    bengali = sum("ঀ" <= c <= "৿" for c in letters)
    latin = sum(c.isascii() for c in letters)
    return ("bn", bengali / len(letters)) if bengali >= latin else ("en", latin / len(letters))


def embedding_similarity(a: str, b: str) -> float:
    """Cosine of two texts' embeddings, all words alike; with weights from a table: operators.embedding.embedder."""
    from .operators.embedding import Embedder

    return loaded(("embedder",), Embedder).similarity(a, b)
