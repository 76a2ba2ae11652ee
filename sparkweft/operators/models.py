"""Language models behind small functions: what they are asked, how long they may take, and how their answers are read.

A chat is any callable of a system and a user message that gives a text, or an iterator of its parts.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterable

from sparkweft.functions.vocabulary import ENTITY_TYPES, RELATION_TYPES, EngineError

Chat = Callable[[str, str], "str | Iterable[str]"]
IDLE_SECONDS, TOTAL_SECONDS = 90.0, 300.0

EXTRACTION = f"""You read one passage of a code base or its documents and list what it names and how these things relate.
Entity types, no others: {", ".join(ENTITY_TYPES)}. Relation types, no others: {", ".join(RELATION_TYPES)}.
Take only what the passage states; leave out what you aren't sure of. Give each item a confidence of 0.6, 0.8 or 1.0.
Answer with JSON alone: {{"entities": [{{"n": name, "t": type, "d": short description, "c": confidence}}], "relations": [{{"s": name, "r": type, "o": name, "d": short description, "c": confidence}}]}}"""
REPAIR = "Your last answer was no valid JSON. Answer with the corrected JSON alone."
SUMMARY = 'You sum up a part of a knowledge graph from its members and relations in at most 80 words: what it stands for, how its parts relate, and where it ends. Answer with JSON alone: {"summary": text}'
SCORING = 'You rate how far each summary answers a question, as whole numbers from 0 (not at all) to 10 (directly). Answer with JSON alone: {"scores": [numbers, one for each summary]}'


def within(call: Callable[[], str | Iterable[str]], idle: float = IDLE_SECONDS, total: float = TOTAL_SECONDS) -> str:
    """The whole answer of a call, given up with TIMEOUT if nothing comes for ``idle`` seconds or not all within ``total``."""
    parts: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            got = call()
            for part in [got] if isinstance(got, str) or got is None else got:
                parts.put((part, None))
            parts.put((None, StopIteration()))
        except BaseException as e:  # noqa: BLE001 - handed over to the caller
            parts.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    said, end = [], time.monotonic() + total
    while True:
        try:
            part, error = parts.get(timeout=max(0.0, min(idle, end - time.monotonic())))
        except queue.Empty:
            raise EngineError("TIMEOUT", f"no answer within {idle} s, or not all of it within {total} s") from None
        if isinstance(error, StopIteration):
            return "".join(said)
        if error is not None:
            raise error
        said.append(part or "")


def braces(text: str) -> str:
    """From the first brace to the last."""
    a, b = text.find("{"), text.rfind("}")
    return text[a : b + 1] if 0 <= a < b else text.strip()


class ChatCompleter:
    """Asks a chat for the entities and relations of a text, and once more with the error if that was no JSON."""

    def __init__(self, chat: Chat):
        self.chat = chat

    def __call__(self, text: str, path: str) -> str | Iterable[str]:
        return self.chat(EXTRACTION, f"Source: {path}\n\n{text}")

    def repair(self, raw: str, error: str) -> str | Iterable[str]:
        return self.chat(REPAIR, f"Last answer:\n{raw}\n\nError: {error}")


def summarizer_of(chat: Chat) -> Callable[[list[str], list[str]], str]:
    """A summary of members and edges, both as lines; an answer of another shape is taken as it is."""

    def summarize(members: list[str], edges: list[str]) -> str:
        raw = within(lambda: chat(SUMMARY, "Members:\n" + "\n".join(members) + "\n\nRelations:\n" + "\n".join(edges)))
        try:
            told = json.loads(braces(raw)).get("summary")
        except (ValueError, AttributeError):
            return raw
        return told if isinstance(told, str) else raw

    return summarize


def scorer_of(chat: Chat) -> Callable[[str, list[str]], list[float]]:
    """Scores of summaries for a question; raises where the answer doesn't fit, so that the caller can fall back."""

    def score(question: str, summaries: list[str]) -> list[float]:
        told = "\n\n".join(f"[{n}] {s}" for n, s in enumerate(summaries))
        return [float(x) for x in json.loads(braces(within(lambda: chat(SCORING, f"Question: {question}\n\n{told}"))))["scores"]]

    return score
