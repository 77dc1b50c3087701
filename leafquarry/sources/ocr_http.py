"""An OCR provider over HTTP: one POST a file, with retries."""

from __future__ import annotations

import base64
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable

from ..operators.enrich import retrying

MAX_BYTES, TIMEOUT, ERROR_BYTES = 200 << 20, 300.0, 200
# MIME types by content type.
MIME = {"pdf": "application/pdf", "png": "image/png", "jpeg": "image/jpeg"}


#: Fixed value: the strict schema of an image's annotation, as the service wants it.
ANNOTATION = {
    "name": "image_annotation",
    "strict": True,
    "schema": {
        "type": "object",
        "properties": {"image_type": {"type": "string", "description": "What kind of image it is"}, "description": {"type": "string", "description": "What the image shows"}},
        "required": ["image_type", "description"],
        "additionalProperties": False,
    },
}


class HttpError(Exception):
    def __init__(self, status: int, body: str, retry_after: str | None):
        super().__init__(f"status {status}: {body[:ERROR_BYTES]}")
        self.status, self.retry_after = status, retry_after


def wait_for(e: Exception) -> float | None:
    """Seconds to wait, 0 for the usual back-off, None for an error that stays: transport errors, 429 and 5xx pass."""
    if isinstance(e, HttpError):
        if e.status != 429 and e.status < 500:
            return None
        try:
            return min(max(float(e.retry_after or 0), 0.0), 60.0)
        except ValueError:
            return 0.0
    return 0.0 if isinstance(e, (OSError, urllib.error.URLError)) else None


def described(markdown: str, images: list[dict] | None) -> str:
    """Markdown with a paragraph for each described image. An annotation is an object, text, or an object in text."""
    for image in images or []:
        a = image.get("image_annotation")
        kind, text = "", ""
        if isinstance(a, str):
            text = a.strip()
            if text.startswith("{"):
                try:
                    a = json.loads(text)
                except ValueError:
                    pass
        if isinstance(a, dict):
            kind, text = str(a.get("image_type") or "").strip(), str(a.get("description") or "").strip()
        if text:
            markdown += f"\n\n[Image: {kind or 'image'} — {text}]"
    return markdown


class HttpOcr:
    """Sends {model, document: {type, url}} with the file as a data URL; reads pages of (index, markdown, images)."""

    price_per_page = 0.005

    def __init__(self, url: str, key: str, model: str, annotation_schema: dict | None = None, post: Callable[[bytes], bytes] | None = None, **retry):
        self.url, self.key, self.model, self.schema, self.post, self.retry = url, key, model, annotation_schema, post or self._post, retry

    def _post(self, body: bytes) -> bytes:
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:  # noqa: S310
                return answer.read()
        except urllib.error.HTTPError as e:
            raise HttpError(e.code, e.read(4096).decode("utf-8", "replace"), e.headers.get("Retry-After")) from e

    def request(self, path: str, content_type: str) -> bytes:
        if os.stat(path).st_size > MAX_BYTES:
            raise ValueError(f"{path}: larger than {MAX_BYTES} bytes")
        with open(path, "rb") as f:
            url = f"data:{MIME[content_type]};base64,{base64.b64encode(f.read()).decode()}"
        kind = "document_url" if content_type == "pdf" else "image_url"
        body: dict = {"model": self.model, "document": {"type": kind, kind: url}}
        if self.schema:
            body["bbox_annotation_format"] = {"type": "json_schema", "json_schema": self.schema}
        return json.dumps(body).encode()

    def ocr_file(self, path: str, content_type: str) -> list[tuple[int, str]]:
        body = self.request(path, content_type)
        answer = json.loads(retrying(lambda: self.post(body), wait_for, **self.retry))
        return [(p["index"], described(p.get("markdown") or "", p.get("images"))) for p in answer.get("pages", [])]
