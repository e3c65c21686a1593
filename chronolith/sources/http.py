"""Landing of paged JSON: a sliding-window rate limit, retries with growing waits, and pages until there is no next link.

The transport is a function that is handed in, so nothing here needs a network; what it lands as JSON files is read by
history.read_documents. This runs on the driver, before any Spark job.
"""

from __future__ import annotations

import random
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime


@dataclass(frozen=True)
class Answer:
    status: int
    body: object = None
    headers: dict = field(default_factory=dict)


#: What a 403 says that asks for a pause, the seconds to wait if it doesn't say how many, and what is added at random.
SECONDARY, SECONDARY_WAIT, JITTER = "secondary rate limit", 60.0, (1.0, 5.0)


class GaveUp(Exception):
    """A request that failed for good; status holds the last answer's."""

    def __init__(self, url: str, status: int):
        super().__init__(f"{url}: {status}")
        self.status = status


class RateWindow:
    """At most `capacity` requests in any `seconds`."""

    def __init__(self, capacity: int = 900, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity, self.seconds, self.clock, self.sleep = capacity, seconds, clock, sleep
        self.taken: deque[float] = deque()

    def acquire(self) -> None:
        while True:
            now = self.clock()
            while self.taken and now - self.taken[0] >= self.seconds:
                self.taken.popleft()
            if len(self.taken) < self.capacity:
                self.taken.append(now)
                return
            self.sleep(self.seconds - (now - self.taken[0]))


def next_link(headers: dict) -> str | None:
    """The rel="next" target of a Link header."""
    value = next((v for k, v in headers.items() if k.lower() == "link"), "")
    found = re.search(r'<([^>]*)>\s*;[^,]*\brel="?next"?', value)
    return found[1] if found else None


def retry_after(value: str | None, now: float, default: float = 0.0) -> float:
    """Seconds that a Retry-After header asks for, given as seconds or as a date; default where it says neither."""
    if value is None:
        return default
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except ValueError:
        return default


def waits(answer: Answer, attempt: int, now: float) -> float | None:
    """Seconds until the next try, or None if the answer is final."""
    headers = {k.lower(): v for k, v in answer.headers.items()}
    if answer.status == 403 and (SECONDARY in str(answer.body).lower() or "retry-after" in headers):
        return retry_after(headers.get("retry-after"), now, SECONDARY_WAIT) + JITTER[0] + (JITTER[1] - JITTER[0]) * random.random()
    if answer.status in (403, 429) and headers.get("x-ratelimit-remaining") == "0":
        return max(0.0, float(headers.get("x-ratelimit-reset", now)) - now)
    if answer.status == 429 and "retry-after" in headers:
        return retry_after(headers["retry-after"], now, 2.0**attempt)
    return 2.0**attempt if answer.status == 429 or answer.status >= 500 else None


def get(url: str, send: Callable[[str], Answer], limit: RateWindow, tries: int = 5, now: Callable[[], float] = time.time) -> Answer | None:
    """The answer to url; None for 404; GaveUp after the last try or a final error."""
    for attempt in range(tries):
        limit.acquire()
        answer = send(url)
        if answer.status == 404:
            return None
        if answer.status < 400:
            return answer
        wait = waits(answer, attempt, now())
        if wait is None or attempt == tries - 1:
            break
        limit.sleep(wait)
    raise GaveUp(url, answer.status)


def pages(url: str, send: Callable[[str], Answer], limit: RateWindow, known: Callable[[list], bool] = lambda items: False, **kw) -> Iterator[list]:
    """Item lists page by page; ends at the last page or at the first whose items are all known."""
    while url:
        answer = get(url, send, limit, **kw)
        if answer is None or not answer.body or known(answer.body):
            return
        yield answer.body
        url = next_link(answer.headers)
