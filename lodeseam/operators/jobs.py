"""Crawl jobs: submitted, run in a thread or at once, and watched."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass


@dataclass
class Job:
    job_id: str
    url: str
    status: str = "pending"
    pages_crawled: int = 0
    pages_unchanged: int = 0
    pages_pruned: int = 0
    chunks_indexed: int = 0
    error: str | None = None


class Jobs:
    """Runs work(url, max_pages, max_depth, prune) -> counts; jobs of one site wait for each other."""

    def __init__(self, work: Callable[..., dict[str, int]]):
        self.work, self._jobs, self._lock, self._sites = work, {}, threading.Lock(), {}

    def submit(self, url: str, max_pages: int | None = None, max_depth: int | None = None, sync: bool = False, prune: bool | None = None) -> dict:
        if max_pages is not None and not 1 <= max_pages <= 500:
            raise ValueError("max_pages must be 1 to 500")
        if max_depth is not None and not 0 <= max_depth <= 10:
            raise ValueError("max_depth must be 0 to 10")
        job = Job(uuid.uuid4().hex, url)
        with self._lock:
            self._jobs[job.job_id] = job
            site = self._sites.setdefault(url.rstrip("/"), threading.Lock())
        if sync:
            self._run(job, site, max_pages, max_depth, prune)
        else:
            threading.Thread(target=self._run, args=(job, site, max_pages, max_depth, prune), daemon=True).start()
        return asdict(job)

    def _run(self, job: Job, site: threading.Lock, max_pages: int | None, max_depth: int | None, prune: bool | None) -> None:
        with site:
            job.status = "running"
            try:
                for k, v in self.work(job.url, max_pages, max_depth, prune).items():
                    if hasattr(job, k):
                        setattr(job, k, v)
                job.status = "completed"
            except Exception as e:  # noqa: BLE001 - a job reports whatever ended it
                job.status, job.error = "failed", str(e)

    def progress(self, job_id: str | None = None) -> dict | list[dict] | None:
        """All jobs, or one; None if it is unknown."""
        with self._lock:
            if job_id is None:
                return [asdict(j) for j in self._jobs.values()]
            return asdict(self._jobs[job_id]) if job_id in self._jobs else None
