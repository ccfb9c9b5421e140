"""Rate-limited HTTP reader with retries; the transport is a parameter, so tests need no network."""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from ..config import MAX_ATTEMPTS, REQUESTS_PER_SECOND

Transport = Callable[[str, dict[str, str]], tuple[int, dict[str, str], bytes]]


class HttpError(Exception):
    def __init__(self, url: str, status: int):
        super().__init__(f"HTTP {status} for {url}")
        self.url, self.status = url, status


class RateLimiter:
    """Token bucket whose capacity is its rate."""

    def __init__(self, rate: float = REQUESTS_PER_SECOND, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.tokens, self.at = float(rate), clock()

    def acquire(self) -> None:
        now = self.clock()
        self.tokens = min(self.rate, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            pause = (1 - self.tokens) / self.rate
            self.sleep(pause)
            self.at, self.tokens = self.clock(), 1.0
        self.tokens -= 1


def urllib_transport(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
            return r.status, dict(r.headers.items()), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers.items()), e.read()


def gunzipped(body: bytes, headers: dict[str, str]) -> bytes:
    """Decompressed if the headers say gzip and it is; else as it came."""
    if {k.lower(): v for k, v in headers.items()}.get("content-encoding", "").lower() == "gzip":
        try:
            return gzip.decompress(body)
        except (OSError, EOFError):
            return body
    return body


def pause_before(attempt: int, headers: dict[str, str]) -> float:
    """Seconds to wait: Retry-After within 0 to 60, else 1, 2, 4 ... up to 10."""
    asked = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
    try:
        return min(60.0, max(0.0, float(asked)))
    except ValueError:
        return min(10.0, 2.0**attempt)


class HttpReader:
    def __init__(self, user_agent: str, transport: Transport = urllib_transport, limiter: RateLimiter | None = None, sleep=time.sleep):
        self.headers = {"User-Agent": user_agent, "Accept-Encoding": "gzip"}
        self.transport, self.limiter, self.sleep = transport, limiter or RateLimiter(), sleep

    def fetch(self, url: str) -> tuple[bytes, dict[str, str]]:
        """Body and headers; exceptions, 429 and 5xx are tried again, other errors raise at once."""
        for attempt in range(MAX_ATTEMPTS):
            self.limiter.acquire()
            last = attempt == MAX_ATTEMPTS - 1
            try:
                status, headers, body = self.transport(url, self.headers)
            except Exception:  # whatever the transport raises, an answer that breaks off too
                if last:
                    raise
                self.sleep(pause_before(attempt, {}))
                continue
            if status < 400:
                return gunzipped(body, headers), headers
            if last or not (status == 429 or status >= 500):
                raise HttpError(url, status)
            self.sleep(pause_before(attempt, headers))
        raise AssertionError("unreachable")

    def fetch_json(self, url: str):
        body, _ = self.fetch(url)
        try:
            return json.loads(body.decode("utf-8"))
        except UnicodeDecodeError:
            return json.loads(body.decode("latin-1"))
