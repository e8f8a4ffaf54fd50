"""Slots for models: loaded once a worker, and generators that are stopped at their limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd

_HELD: dict[str, Any] = {}


@dataclass(frozen=True)
class Loaded:
    """A model by a name and the function that loads it; only these two travel to the workers.

    ``load`` gives a function (an encoder, a scorer, a generator), called as this object is. Each Python worker loads a name
    once and keeps it for all its tasks.
    """

    name: str
    load: Callable[[], Callable]

    def __call__(self, *args):
        if self.name not in _HELD:
            _HELD[self.name] = self.load()
        return _HELD[self.name](*args)


@dataclass(frozen=True)
class Tokens:
    """A generator slot for models that say their text token by token: ``stream`` gives an iterator for a prompt."""

    stream: Callable[[str], Iterator[str]]

    def said(self, prompt: str | None, most: int | None = None) -> str | None:
        """The tokens up to the one with which they are ``most`` characters; the iterator is closed there."""
        if prompt is None:
            return None
        out, total, stream = [], 0, self.stream(prompt)
        try:
            for token in stream:
                out.append(token)
                total += len(token)
                if most is not None and total >= most:
                    break
        finally:
            close = getattr(stream, "close", None)
            if close:
                close()
        return "".join(out)


def as_batch(generate: Callable[[pd.Series], pd.Series] | Tokens, most: int | None = None) -> Callable[[pd.Series], pd.Series]:
    """A function of pandas series for a generator of either kind."""
    if isinstance(generate, Tokens):
        return lambda prompts: pd.Series([generate.said(p, most) for p in prompts], index=prompts.index, dtype=object)
    return lambda prompts: generate(prompts)
