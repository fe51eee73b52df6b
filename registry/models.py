"""Model stand-ins whose answers can be written down in SQL.

Each is built inside a function, so that Spark ships it to the workers by value.
"""

from __future__ import annotations

from collections.abc import Callable

from codeprep.operators.scoring import ModelFn

MODEL_VERSION = "v1.0"


def length_model() -> ModelFn:
    """Repeats the prompt, then names its length; fails where the length ends in 0."""

    def answer(prompts: list[str]) -> list[str]:
        bad = [len(p) for p in prompts if len(p) % 10 == 0]
        if bad:
            raise ValueError(f"cannot answer length {bad[0]}")
        return [f"{p}\n  ICD-9:{len(p)} ,\tX-{len(p) % 7},, plain \n" for p in prompts]

    return answer


def many_codes_model() -> ModelFn:
    """More codes than the default limit, some of them with a known description."""

    def answer(prompts: list[str]) -> list[str]:
        tail = ", ".join(f"N-{i}" for i in range(12))
        return [f"{p} ICD-10:I10, ICD-9:{len(p)}, ICD-10:E11.9, {tail}" for p in prompts]

    return answer


def page_reader() -> Callable[[bytes], list[str | None]]:
    """Reads files of an id, a kind and a text in base64 as two pages; refuses the kind ``bad``."""

    def pages(data: bytes) -> list[str | None]:
        import base64

        _, kind, body = data.decode().strip().split(":")
        if kind == "bad":
            raise ValueError("cannot read this file")
        text = base64.b64decode(body).decode()
        return [None] if kind == "empty" else [text[: len(text) // 2], text[len(text) // 2 :]]

    return pages
