"""An HTTP service over a workspace: /, /geocode, /status, /openapi.json and /docs.

`answer` is the whole service as a function, so that tests need no socket.  One request is one small plan; many queries
belong in `gazetteer.query.geocode`, which takes them as a table.
"""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .functions.shapes import parse_region
from .functions.text import query_param
from .presets import check_levels, check_quality, check_template
from .query import Tables, document, geocode
from .workspace import Workspace

ROUTES = ("/", "/geocode", "/status", "/openapi.json", "/docs")
JSON, HTML = "application/json", "text/html; charset=utf-8"
_PARAMETERS = {
    "query": "an address, or lat,lon", "friendly_name_format": "template with {admin_level_N_name} and {house_number}", "quality": "0 to 1", "bounding_wkt": "POLYGON or MULTIPOLYGON, x y order",
    "last_admin_levels": "levels of a match's last part, comma-separated", "include_wkt": "false leaves geometries out",
}
INDEX_PAGE = "<!doctype html><title>geocoder</title><form action=/geocode><input name=query placeholder='address or lat,lon'><button>find</button></form><p><a href=/docs>documentation</a> <a href=/status>status</a>"
DOCS_PAGE = "<!doctype html><title>documentation</title><h1>GET /geocode</h1><dl>" + "".join(f"<dt>{k}<dd>{v}" for k, v in _PARAMETERS.items()) + "</dl><p><a href=/openapi.json>openapi.json</a>"


def openapi() -> dict:
    parameter = lambda k, v: {"name": k, "in": "query", "required": k == "query", "description": v, "schema": {"type": "string"}}
    ok = {"200": {"description": "ok"}}
    geo = {"parameters": [parameter(k, v) for k, v in _PARAMETERS.items()], "responses": ok | {"400": {"description": "bad parameter"}, "503": {"description": "text search unavailable"}}}
    return {"openapi": "3.0.3", "info": {"title": "geocoder", "version": "1"}, "paths": {"/geocode": {"get": geo}, "/status": {"get": {"responses": ok | {"503": {"description": "a service is missing"}}}}}}


def _error(code: int, message: str) -> tuple[int, str, str]:
    return code, JSON, json.dumps({"error": message})


def options_of(query_string: str) -> dict:
    """The filters of a request; ValueError where one can't be read.  A quality that can't be read counts as none."""
    get = lambda k: query_param(query_string, k)
    out: dict = {"include_wkt": get("include_wkt") != "false"}
    if (t := get("friendly_name_format")) is not None:
        out["template"] = check_template(t)
    if (r := get("bounding_wkt")) is not None:
        parse_region(r)
        out["region"] = r
    if (levels := get("last_admin_levels")) is not None:
        out["levels"] = tuple(check_levels(levels))
    if (q := get("quality")) is not None:
        try:
            out["min_quality"] = check_quality(q)
        except ValueError:
            pass
    return out


def run_query(tables: Tables, text: str, **options) -> dict | None:
    """The answer to one query; None if it needs the text index and there is none."""
    spark = tables.areas.sparkSession
    rows = geocode(tables, spark.createDataFrame([(0, text)], "query_id long, text string"), **options).orderBy("rank").collect()  # ten at most
    if rows:
        return document(rows[0]["service"], [r.asDict(recursive=True) for r in rows])
    is_point = is_coordinates(text)
    if not is_point and tables.index is None:
        return None
    return document("coordinates_to_address" if is_point else "text_to_address", [])


def is_coordinates(text: str) -> bool:
    """Does a query read lat,lon in range?"""
    lat, comma, lon = text.partition(",")
    try:
        return bool(comma) and abs(float(lat)) <= 90 and abs(float(lon)) <= 180
    except ValueError:
        return False


def answer(ws: Workspace, tables: Tables, method: str, url: str) -> tuple[int, str, str]:
    """(status, content type, body) of a request."""
    path, _, query_string = url.partition("?")
    if path not in ROUTES:
        return _error(404, "not found")
    if method == "OPTIONS":
        return 204, JSON, ""
    if method != "GET":
        return _error(405, "method not allowed")
    if path == "/":
        return 200, HTML, INDEX_PAGE
    if path == "/docs":
        return 200, HTML, DOCS_PAGE
    if path == "/openapi.json":
        return 200, JSON, json.dumps(openapi())
    if path == "/status":
        report = ws.status()
        return (200 if report["is_ok"] else 503), JSON, json.dumps(report)
    text = query_param(query_string, "query")
    if text is None:
        return _error(400, "missing query param: query")
    try:
        options = options_of(query_string)
    except ValueError as e:
        return _error(400, str(e))
    if tables.index is None and not is_coordinates(text):
        return _error(503, "text_to_address service unavailable")
    return 200, JSON, json.dumps(run_query(tables, text, **options), ensure_ascii=False)


def serve(ws: Workspace, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready to run (`serve_forever`); the tables are those at hand when it starts."""
    tables = Tables.of(ws)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def reply(self) -> None:
            began = time.perf_counter()
            status, kind, body = answer(ws, tables, self.command, self.path)
            raw = body.encode()
            self.send_response(status)
            self.send_header("Access-Control-Allow-Origin", "*")
            if status == 204:
                self.send_header("Access-Control-Allow-Methods", "GET, OPTIONS")
                self.send_header("Access-Control-Allow-Headers", "Content-Type")
            else:
                self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)
            print(f"{status} {self.command} {self.path} in {(time.perf_counter() - began) * 1000:.0f}ms", flush=True)

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_OPTIONS = reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
