"""Local model servers: started one after the other, waited for until they are healthy, stopped for certain."""

from __future__ import annotations

import contextlib
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence


def healthy(url: str, timeout: float = 5.0) -> bool:
    """Whether a GET is answered with a status below 400, without proxies."""
    try:
        with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(url, timeout=timeout) as r:
            return r.status < 400
    except (urllib.error.URLError, OSError):
        return False


@contextlib.contextmanager
def serving(command: Sequence[str], url: str, wait: float = 600.0, every: float = 2.0, check: Callable[[str], bool] = healthy) -> Iterator[subprocess.Popen]:
    """A server process while it is needed. One that ends or isn't healthy in time is an error."""
    process = subprocess.Popen(list(command))
    try:
        until = time.monotonic() + wait
        while not check(url):
            if process.poll() is not None:
                raise RuntimeError(f"the server ended with {process.returncode}")
            if time.monotonic() > until:
                raise TimeoutError(f"no answer at {url} within {wait:.0f} s")
            time.sleep(every)
        yield process
    finally:
        process.terminate()
        try:
            process.wait(20)
        except subprocess.TimeoutExpired:
            process.kill()
            process.wait()


def in_turn(servers: Sequence[tuple[Sequence[str], str]], work: Callable[[int], None], **options) -> None:
    """work(i) while the i-th (command, health address) runs, one server at a time: they share a device."""
    for i, (command, url) in enumerate(servers):
        with serving(command, url, **options):
            work(i)
