"""Protocols for parts that need a model or a service, with offline stand-ins."""

from __future__ import annotations

from typing import Protocol


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """Logits for a query and texts; retrieval.lexical_rerank stands in."""

    def score(self, query: str, texts: list[str]) -> list[float]: ...


class ChatModel(Protocol):
    def generate(self, question: str, evidence: list[dict]) -> str: ...


class Judge(Protocol):
    def evaluate(self, question: str, answer: str, evidence: list[dict]) -> float: ...


class PageReader(Protocol):
    """Blocks of a binary document (PDF, DOCX, scan); spark.read.format("binaryFile") feeds it."""

    def read(self, content: bytes) -> list[dict]: ...


class SentenceParser(Protocol):
    """Dependency tokens (id, head, deprel, upos, lemma) of a text; learning.dependency_triplets reads them."""

    def parse(self, text: str) -> list[dict]: ...


class Lemmatizer(Protocol):
    def lemma(self, word: str) -> str: ...


class SameWord:
    """Where no dictionary is at hand, a word is its own lemma."""

    def lemma(self, word: str) -> str:
        return word.lower()
