"""A log of steps, as Markdown and as JSON lines."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from .tables import under, write_text


class PipelineLogger:
    """Appends steps with their settings and the first rows of their tables; files begin empty.

    The folder may be on any file system; remote files are written anew with
    each step, as not all systems can append.
    """

    def __init__(self, folder: str, name: str = "log", markdown: bool = True, jsonl: bool = True, max_rows: int = 20):
        self.folder, self.max_rows = str(folder), max_rows
        self.markdown = under(self.folder, f"{name}.md") if markdown else None
        self.jsonl = under(self.folder, f"{name}.jsonl") if jsonl else None
        self.written: dict[str, str] = {}
        for file in (self.markdown, self.jsonl):
            if file:
                write_text(file, "")

    def _append(self, file: str, text: str) -> None:
        if "://" not in file:
            with open(file, "a") as f:
                f.write(text)
            return
        self.written[file] = self.written.get(file, "") + text
        write_text(file, self.written[file])

    def log_step(self, step_name: str, info: dict | None = None, df=None, max_rows: int | None = None) -> None:
        """``df``: a table, a list or a dict of tables, or None."""
        rows = self.max_rows if max_rows is None else max_rows
        tables = {} if df is None else df if isinstance(df, dict) else {f"table_{i}": d for i, d in enumerate(df)} if isinstance(df, (list, tuple)) else {"table": df}
        samples = {k: self._head(d, rows) for k, d in tables.items() if isinstance(d, DataFrame)}
        now = datetime.now(timezone.utc).isoformat()
        if self.markdown:
            self._log_to_markdown(now, step_name, info or {}, samples)
        if self.jsonl:
            self._log_to_json(now, step_name, info or {}, samples)

    @staticmethod
    def _head(df: DataFrame, rows: int) -> tuple[list[str], list[list]]:
        return df.columns, [list(r) for r in df.limit(rows).collect()]

    def _log_to_markdown(self, now: str, step: str, info: dict, samples: dict) -> None:
        lines = [f"## {step}", "", f"*{now}*", "", "```json", json.dumps(info, indent=2, default=str), "```", ""]
        for name, (columns, rows) in samples.items():
            cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
            lines += [f"**{name}**", "", "| " + " | ".join(map(cell, columns)) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""]
        self._append(self.markdown, "\n".join(lines) + "\n")

    def _log_to_json(self, now: str, step: str, info: dict, samples: dict) -> None:
        entry = {"timestamp": now, "step": step, "parameters": info, "data_samples": {k: [dict(zip(c, r)) for r in rows] for k, (c, rows) in samples.items()}}
        self._append(self.jsonl, json.dumps(entry, default=str) + "\n")
