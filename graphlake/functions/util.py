"""Small tools beside the DataFrame operators."""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class BoundedStack:
    """A stack of at most ``max_step`` items; a push beyond that forgets the oldest."""

    def __init__(self, max_step: int = 10):
        self._items: deque = deque(maxlen=max_step)
        self.max_step = max_step

    def __len__(self) -> int:
        return len(self._items)

    def is_empty(self) -> bool:
        return not self._items

    def is_full(self) -> bool:
        return len(self._items) == self.max_step

    def push(self, item: Any) -> None:
        self._items.append(item)

    def pop(self) -> Any:
        """The newest item, or None."""
        return self._items.pop() if self._items else None

    def peek(self) -> Any:
        return self._items[-1] if self._items else None

    def to_list(self) -> list:
        """Newest first."""
        return list(reversed(self._items))

    def clear(self) -> None:
        self._items.clear()


def unique_id(index: int = 0) -> str:
    return f"{index}-" + "".join(random.choices("0123456789", k=10))


def submit(operator: Callable, *args: Any, **kwargs: Any) -> Future:
    """Runs an operator in a thread of its own, which inherits the session's local properties; its error is the future's."""
    future: Future = Future()

    def run() -> None:
        try:
            future.set_result(operator(*args, **kwargs))
        except BaseException as e:  # noqa: BLE001
            future.set_exception(e)

    session = SparkSession.getActiveSession()
    (InheritableThread(target=run, session=session) if session is not None else InheritableThread(target=run)).start()
    return future


def submit_all(calls: list[Callable[[], Any]], threads: int = 4) -> list:
    """The results of several calls, at most ``threads`` at a time."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda f: f(), calls))
