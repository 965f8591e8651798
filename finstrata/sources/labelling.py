"""Uploading tasks to a labelling server, and fetching its exports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXPORT_TASK


@dataclass(frozen=True)
class LabellingClient:
    """Requests to the server at ``url`` with an access ``token``; ``open_url`` sends them and can be replaced in tests."""

    url: str
    token: str
    open_url: Callable = urlopen

    def request(self, method: str, path: str, payload: object = None) -> object:
        """The JSON that the server answers; null for an empty answer."""
        headers = {"Authorization": f"Token {self.token}", "Content-Type": "application/json"}
        body = None if payload is None else json.dumps(payload).encode()
        with self.open_url(Request(self.url.rstrip("/") + path, data=body, headers=headers, method=method)) as answer:
            text = answer.read()
        return json.loads(text) if text else None

    def create_task(self, task: dict) -> None:
        self.request("POST", "/api/tasks", task)

    def export(self, project: int) -> list[dict]:
        """The whole export of a project; for large ones see :func:`fetch_tasks`."""
        return self.request("GET", f"/api/projects/{project}/export?exportType=JSON") or []

    def tasks(self, project: int, page: int, size: int) -> list[dict]:
        """One page of a project's tasks with their annotations; pages count from 1."""
        found = self.request("GET", f"/api/tasks?project={project}&page={page}&page_size={size}&fields=all")
        return found.get("tasks", []) if isinstance(found, dict) else found or []


def upload_tasks(tasks: DataFrame, client: LabellingClient, column: str = "task") -> None:
    """Posts the JSON in ``column`` of every row, partition by partition; null rows are skipped.

    A partition that is run again posts its rows again, so a task may arrive twice.
    """

    def send(rows: Iterator) -> None:
        for r in rows:
            if r[0] is not None:
                client.create_task(json.loads(r[0]))

    tasks.select(column).foreachPartition(send)


def fetch_tasks(spark: SparkSession, client: LabellingClient, project: int, total: int, size: int = 100, parallel: int = 8) -> DataFrame:
    """(task_idx, data, annotations) of a project of ``total`` tasks, ``size`` a request, by at most ``parallel`` tasks at a time.

    Numbered in their order; :func:`finstrata.sources.records.export_chunks` reads them.
    """
    pages = spark.range(1, -(-total // size) + 1, 1, parallel)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for page in b["id"]:
                found = client.tasks(project, int(page), size)
                yield pd.DataFrame({"task_idx": range((page - 1) * size, (page - 1) * size + len(found)), "value": [json.dumps(t) for t in found]})

    return pages.mapInPandas(fetch, "task_idx long, value string").select("task_idx", F.from_json("value", EXPORT_TASK).alias("t")).select("task_idx", "t.*")
