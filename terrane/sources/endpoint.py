"""A labeller that asks an OpenAI-compatible endpoint, a window at a time. Off by default: the offline labeller needs no network."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPERATURE, MAX_TOKENS = 0.2, 8192
PROMPT = """Ты описываешь узлы программы. Ответь одним объектом JSON вида
{"labels": {"<id>": {"label": "...", "summary": "...", "group_id": null}}}
Для каждого id из списка нужны label и summary. Соседние узлы одного смысла получают общий group_id.
Типы элементов:
@PALETTE@
Узлы:
@NODES@
"""


class EndpointError(ValueError):
    pass


def _ask(url: str, api_key: str, body: dict | None = None, timeout: float = 600):
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        text = e.read().decode("utf-8", "replace")
        raise EndpointError(classify(e.code, text)) from e


def classify(status: int, text: str) -> str:
    """A message that tells a prompt too large for the model from other faults."""
    low = text.lower()
    if "context" in low and ("length" in low or "size" in low or "window" in low):
        return f"the prompt is larger than the model's context: {text}"
    return f"the endpoint answered {status}: {text}"


def models(base_url: str, api_key: str = "") -> list[str]:
    """Ids of the endpoint's models."""
    return [m["id"] for m in _ask(base_url.rstrip("/") + "/models", api_key)["data"]]


def complete(base_url: str, model: str, messages: list[dict], api_key: str = "") -> str:
    """The reply to a conversation, which grows by it."""
    body = {"model": model, "messages": messages, "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS, "response_format": {"type": "json_object"}}
    text = _ask(base_url.rstrip("/") + "/chat/completions", api_key, body)["choices"][0]["message"]["content"]
    messages.append({"role": "assistant", "content": text})
    return text


def palette_description(palette: list[dict]) -> str:
    return "\n".join(f"- {p['type']}: {p['label']} — {p['description']}" for p in palette)


def object_in(text: str) -> dict:
    """The JSON object in a reply; {} if there is none."""
    s = text.strip()
    if not s.startswith("{"):
        a, b = s.find("{"), s.rfind("}")
        s = s[a : b + 1] if 0 <= a < b else "{}"
    try:
        found = json.loads(s)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def labeller(settings: dict):
    """A labeller for terrane.operators.labels: each window is one request from the task that holds it."""
    base_url, model, api_key, palette = settings["base_url"], settings["model"], settings.get("api_key", ""), palette_description(settings["palette"])

    def one(f: pd.DataFrame) -> pd.DataFrame:
        rows = [{"id": r.id, "kind": r.kind, "label": r.label, "lines": [r.start_line, r.end_line]} for r in f.itertuples()]
        text = PROMPT.replace("@PALETTE@", palette).replace("@NODES@", json.dumps(rows, ensure_ascii=False, default=str))
        found = object_in(complete(base_url, model, [{"role": "user", "content": text}], api_key)).get("labels", {})
        out = [(f["report"].iloc[0], i, str(x.get("label") or ""), str(x.get("summary") or ""), x.get("group_id")) for i, x in found.items() if isinstance(x, dict)]
        return pd.DataFrame(out, columns=["report", "id", "label", "summary", "group_id"])

    def ask(nodes: DataFrame) -> DataFrame:
        rows = nodes.select("report", "window_no", "id", "kind", "label", F.col("start_line").cast("string").alias("start_line"), F.col("end_line").cast("string").alias("end_line"))
        return rows.groupBy("report", "window_no").applyInPandas(one, "report STRING, id STRING, label STRING, summary STRING, group_id STRING")

    return ask
