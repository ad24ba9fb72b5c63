"""Tools of other servers: which servers there are, where they were found, what may be called, and what went wrong."""

from __future__ import annotations

import json
import re
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Errors that are kept for reading, the latest ones.
KEPT_ERRORS = 1_000
_HIDDEN = re.compile(r"(?i)\b(bearer\s+|(?:token|secret|password|api_?key)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;]+")
_ADVICE = {
    "blocked": (False, "allow the tool by name if it may write"),
    "unavailable": (True, "read last_error and auth_action of the server, then connect it again"),
    "timeout": (True, "call again with a smaller request"),
    "argument": (False, "read the tool's parameters"),
    "failed": (False, "read the message"),
}


@dataclass(frozen=True)
class Tool:
    """A callable by name: what it takes, whether it only reads, and the server that has it (empty: the engine)."""

    name: str
    about: str
    parameters: tuple[str, ...]
    call: Callable[..., Any] = field(repr=False)
    read_only: bool = True
    server: str = ""


@dataclass(frozen=True)
class Server:
    """A server as one source names it. Of several of one name the first that is enabled counts, the others are shadowed."""

    name: str
    transport: str
    source: str = ""
    enabled: bool = True
    state: str = "connected"
    auth_status: str = "none"
    auth_action: str | None = None


class Refused(RuntimeError):
    """A call that was not made: its kind is blocked or unavailable."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Bridge:
    """The catalogue of tools and servers, held on the driver: its size is that of a configuration, not of data."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tools: dict[str, Tool] = {}
        self.writable: set[str] = set()
        self._found: list[Server] = []
        self._errors: deque[tuple] = deque(maxlen=KEPT_ERRORS)
        self._last: dict[str, str] = {}

    def add_server(self, server: Server) -> None:
        self._found.append(server)

    def _active(self) -> dict[str, Server]:
        out: dict[str, Server] = {}
        for s in self._found:
            if s.enabled:
                out.setdefault(s.name, s)
        return out

    def why_not(self, tool: Tool) -> tuple[str, str] | None:
        """(kind, reason) why a tool cannot be called, or None."""
        if not tool.read_only and tool.name not in self.writable:
            return "blocked", "it may write and is not allowed by name"
        if tool.server:
            server = self._active().get(tool.server)
            if server is None:
                return "unavailable", f"server {tool.server} is not known or not enabled"
            if server.state != "connected":
                return "unavailable", f"server {tool.server} is {server.state}"
        return None

    def call(self, tool: Tool, given: dict[str, Any]) -> Any:
        """The tool's answer. What fails at another server is kept with advice, secrets taken out, and raised."""
        try:
            if no := self.why_not(tool):
                raise Refused(no[0], f"{tool.name}: {no[1]}")
            return tool.call(**given)
        except Exception as e:
            if tool.server:
                kind = e.kind if isinstance(e, Refused) else "timeout" if isinstance(e, TimeoutError) else "argument" if isinstance(e, (TypeError, ValueError)) else "failed"
                message = _HIDDEN.sub(r"\1***", str(e))
                self._last[tool.server] = message
                self._errors.append((kind, tool.server, tool.name, *_ADVICE[kind], message, uuid.uuid4().hex))
            raise

    def rows(self, tool: Tool, given: dict[str, Any]) -> DataFrame:
        """An answer as rows: a DataFrame as it is, records by their keys, anything else as one JSON cell."""
        answer = self.call(tool, given)
        if isinstance(answer, DataFrame):
            return answer
        if isinstance(answer, list) and answer and all(isinstance(x, dict) for x in answer):
            names = list(dict.fromkeys(k for x in answer for k in x))
            texts = [[x.get(n) if x.get(n) is None or isinstance(x.get(n), str) else json.dumps(x[n]) for n in names] for x in answer]
            return self.spark.createDataFrame(texts, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
        return self.spark.createDataFrame([(json.dumps(answer),)], "result string")

    @staticmethod
    def macro(tool: Tool) -> str | None:
        """The table function of a bridged tool."""
        return re.sub(r"[^a-z0-9]+", "_", f"mcp_{tool.server}_{tool.name}".lower()) if tool.server else None

    def listed(self) -> DataFrame:
        """name, about, parameters, read_only, server, macro, callable, reason."""
        rows = []
        for t in self.tools.values():
            no = self.why_not(t)
            rows.append((t.name, t.about, ",".join(t.parameters), t.read_only, t.server or None, self.macro(t), no is None, no and no[1]))
        return self.spark.createDataFrame(rows, "name string, about string, parameters string, read_only boolean, server string, macro string, callable boolean, reason string")

    def servers(self) -> DataFrame:
        """name, transport, state, auth_status, auth_action, tool_count, last_error: a row per server, errors or not."""
        counts = [t.server for t in self.tools.values()]
        rows = [(s.name, s.transport, s.state, s.auth_status, s.auth_action, counts.count(s.name), self._last.get(s.name)) for s in self._active().values()]
        return self.spark.createDataFrame(rows, "name string, transport string, state string, auth_status string, auth_action string, tool_count long, last_error string")

    def sources(self) -> DataFrame:
        """name, transport, source, status of everything found: active, shadowed or disabled."""
        active = self._active()
        rows = [(s.name, s.transport, s.source, "disabled" if not s.enabled else "active" if active[s.name] is s else "shadowed") for s in self._found]
        return self.spark.createDataFrame(rows, "name string, transport string, source string, status string")

    def errors(self) -> DataFrame:
        """error_category, server, tool, retryable, next_action, redacted_message, correlation_id of the latest errors."""
        return self.spark.createDataFrame(list(self._errors), "error_category string, server string, tool string, retryable boolean, next_action string, redacted_message string, correlation_id string")
