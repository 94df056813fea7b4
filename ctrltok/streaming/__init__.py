"""Streaming entry points (Structured Streaming)."""

from ctrltok.streaming.corpus_stream import read_pair_stream, start_control_corpus_stream

__all__ = ["read_pair_stream", "start_control_corpus_stream"]
