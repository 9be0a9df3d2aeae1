"""Models that a worker loads once: a factory travels to the workers, its model stays there."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_sessions: dict[str, Any] = {}


def session(key: str, factory: Callable[[], Any]) -> Any:
    """The worker's model of this key; a model of another key gives way."""
    if key not in _sessions:
        _sessions.clear()
        _sessions[key] = factory()
    return _sessions[key]


def onnx(file_name: str):
    """A session of a model file that ``SparkContext.addFile`` has sent to every worker."""
    import onnxruntime
    from pyspark import SparkFiles

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(SparkFiles.get(file_name), options)
