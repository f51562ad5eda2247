"""The engine over HTTP with the standard library only.

POST /api/execute {"query"}: a SELECT's query_id at once, other statements when done; GET /api/tables;
GET /api/table/NAME; GET /api/query/ID/progress; GET /api/query/ID/result; DELETE /api/query/ID; GET /: a small page.
Answers have success, and error where it is false; a statement that fails is an answer like others (200), a request that
can't be read isn't. Values are {"type": "Integer" | "Varchar" | "Boolean" | "Null" | ..., "value"}.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote

from .errors import SqlError
from .session import Engine, Result

MOST_BYTES = 64 << 20


def tagged(v: Any) -> dict:
    if v is None:
        return {"type": "Null"}
    if isinstance(v, bool):
        return {"type": "Boolean", "value": v}
    if isinstance(v, int):
        return {"type": "Integer", "value": v}
    if isinstance(v, float):
        return {"type": "Double", "value": v}
    return {"type": "Varchar", "value": v if isinstance(v, str) else str(v)}


def result_json(r: Result) -> dict:
    return {"columns": list(r.columns), "rows": [[tagged(v) for v in row] for row in r.rows]}


PAGE = """<!DOCTYPE html><meta charset="utf-8"><title>corrie</title>
<style>body{font:15px sans-serif;margin:2em}textarea{width:100%;height:6em}td,th{border:1px solid #bbb;padding:2px 8px}table{border-collapse:collapse}</style>
<h1>corrie</h1><p id="tables"></p><textarea id="sql">SELECT 1 AS x FROM t</textarea><p><button id="run">Run</button> <span id="state"></span></p><table id="out"></table>
<script>
const at = id => document.getElementById(id), ask = (path, options) => fetch("/api" + path, options).then(r => r.json());
const list = () => ask("/tables").then(t => at("tables").textContent = t.tables.map(x => x.name + " (" + (x.row_count ?? "?") + ")").join(", "));
function show(r) {
  const row = (cells, tag) => { const tr = at("out").insertRow(); for (const c of cells) { const td = document.createElement(tag); td.textContent = c; tr.append(td); } };
  at("out").replaceChildren();
  if (r && r.columns.length) { row(r.columns, "th"); for (const x of r.rows.slice(0, 1000)) row(x.map(v => v.value ?? "NULL"), "td"); }
}
at("run").onclick = async () => {
  let r = await ask("/execute", {method: "POST", body: JSON.stringify({query: at("sql").value})});
  while (r.query_id) {
    const p = (await ask("/query/" + r.query_id + "/progress")).progress;
    at("state").textContent = p.status + " " + p.completed_tasks + "/" + p.tasks;
    if (p.status !== "Running") { r = await ask("/query/" + r.query_id + "/result"); break; }
    await new Promise(f => setTimeout(f, 300));
  }
  at("state").textContent = r.success ? Math.round(r.execution_time_ms) + " ms" : r.error;
  show(r.result); list();
};
list();
</script>"""


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, value: dict | str, status: int = 200) -> None:
            body = (value if isinstance(value, str) else json.dumps(value)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(value, str) else "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(body)

        def guarded(self, route) -> None:
            try:
                found = route([unquote(p) for p in self.path.split("?")[0].strip("/").split("/")])
                self.answer({"success": False, "error": "not found"} if found is None else found, 404 if found is None else 200)
            except SqlError as e:
                self.answer({"success": False, "error": str(e)})
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                self.answer({"success": False, "error": f"bad request: {e}"}, 400)

        def do_POST(self) -> None:
            def route(parts: list[str]) -> dict | None:
                if parts != ["api", "execute"]:
                    return None
                n = int(self.headers.get("Content-Length") or 0)
                if n > MOST_BYTES:
                    raise ValueError("the query is too long")
                query = json.loads(self.rfile.read(n) or b"{}").get("query", "").strip()
                if not query:
                    return {"success": False, "error": "the query is empty"}
                if query[:6].upper() == "SELECT":
                    return {"success": True, "query_id": engine.execute_async(query)}
                result, cached, ms = engine.execute_with_cache_info(query)
                return {"success": True, "result": result_json(result), "from_cache": cached, "execution_time_ms": ms}

            self.guarded(route)

        def do_GET(self) -> None:
            def table(name: str) -> dict:
                pending = {"has_pending_buffer": engine.has_pending_buffer_data(name), "pending_buffer_rows": engine.pending_buffer_row_count(name), "has_pending_files": engine.has_pending_data_files(name), "pending_file_count": engine.pending_data_file_count(name)}
                return {"name": name, "row_count": engine.known_row_count(name), **pending}

            def route(parts: list[str]) -> dict | str | None:
                if parts == [""]:
                    return PAGE
                if parts == ["api", "tables"]:
                    return {"success": True, "tables": [table(n) for n in engine.list_tables()]}
                if parts[:2] == ["api", "table"] and len(parts) == 3:
                    s = engine.table_stats(parts[2])
                    return {"success": True, "schema": {"name": s["name"], "columns": engine.describe(s["name"]), "stats": {"row_count": s["rows"], "storage_size_bytes": s["bytes"]}}}
                if parts[:2] == ["api", "query"] and len(parts) == 4 and parts[3] == "progress":
                    return {"success": True, "progress": engine.query_progress(parts[2])}
                if parts[:2] == ["api", "query"] and len(parts) == 4 and parts[3] == "result":
                    r, p = engine.query_result(parts[2]), engine.query_progress(parts[2])
                    if r is None:
                        return {"success": False, "error": "the query is still running"}
                    return {"success": True, "result": result_json(r), "from_cache": p["from_cache"], "execution_time_ms": p["elapsed_ms"]}
                return None

            self.guarded(route)

        def do_DELETE(self) -> None:
            def route(parts: list[str]) -> dict | None:
                if parts[:2] != ["api", "query"] or len(parts) != 3:
                    return None
                done = engine.cancel(parts[2])
                return {"success": done, "message": "cancelled" if done else "it had ended"}

            self.guarded(route)

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for k, v in (("Origin", "*"), ("Methods", "GET, POST, DELETE"), ("Headers", "Content-Type")):
                self.send_header(f"Access-Control-Allow-{k}", v)
            self.end_headers()

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def server(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Not yet running: call serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(engine))
