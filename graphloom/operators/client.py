"""Models behind an HTTP interface: dialects, requests, replies, and waits between attempts.

Nothing here opens a connection by itself: :class:`HttpModel` is given the
function that posts, so that tests, proxies and secrets stay outside.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

#: Part of the address or of the model's name, and the dialect that it tells of; tried in order; fixed values.
ADDRESSES = [("dashscope.aliyuncs.com", "dashscope"), ("deepseek", "deepseek"), ("openai", "openai-compatible"), ("zhipuai", "zhipu")]
BY_NAME = ("deepseek",)
#: Seconds that a request may take, of the first wait, and more for each attempt when the service is limiting rates; fixed values.
TIMEOUT, FIRST_WAIT, LIMITED_WAIT = 300, 30, 5

Post = Callable[[str, dict, dict, int], tuple[int, str]]


def dialect(url: str, model: str) -> str:
    for part, name in ADDRESSES:
        if part in url or (part in BY_NAME and part in model.lower()):
            return name
    return "unknown"


def request(prompt: str, url: str, model: str, key: str, *, temperature: float = 0.0, **more) -> tuple[dict, dict]:
    """Headers and body of one prompt."""
    headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
    if dialect(url, model) == "dashscope":
        headers["Accept"] = "application/json"
    return headers, {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, **more}


def reply(body: dict, kind: str) -> str:
    """The text of a reply. Only the unknown shapes of a general dialect are returned as they are."""
    output = body.get("output") if kind == "dashscope" else None
    choices = body.get("choices") or (output or {}).get("choices")
    if choices:
        first = choices[0]
        text = (first.get("message") or {}).get("content", first.get("text") if kind == "dashscope" else None)
        if text is not None:
            return text
    elif output and "text" in output:
        return output["text"]
    elif kind != "dashscope" and "choices" not in body:
        return json.dumps(body, ensure_ascii=False)
    raise ValueError("the reply has an unknown shape")


def is_limited(problem: str) -> bool:
    return "429" in problem or "rate limit" in problem.lower()


def wait_after(attempt: int, problem: str, first: float = FIRST_WAIT) -> float:
    """Seconds before the next attempt: doubled each time, and more if the service limits rates."""
    return first * 2**attempt + (LIMITED_WAIT * (attempt + 1) if is_limited(problem) else 0)


class HttpModel:
    """A model function over a service. ``post`` takes (url, headers, body, timeout) and gives (status, text)."""

    def __init__(self, post: Post, url: str, model: str, key: str, *, retries: int = 3, sleep: Callable[[float], None] = time.sleep, first_wait: float = FIRST_WAIT, timeout: int = TIMEOUT, **more):
        if not key:
            raise ValueError("the service needs a key")
        self.post, self.url, self.model, self.key = post, url, model, key
        self.retries, self.sleep, self.first_wait, self.timeout, self.more = retries, sleep, first_wait, timeout, more

    def once(self, prompt: str) -> str:
        headers, body = request(prompt, self.url, self.model, self.key, **self.more)
        status, text = self.post(self.url, headers, body, self.timeout)
        if status != 200:
            raise ValueError(f"the service answers {status}: {text[:200]}")
        return reply(json.loads(text), dialect(self.url, self.model))

    def answer(self, prompt: str) -> str:
        for attempt in range(self.retries):
            try:
                return self.once(prompt)
            except Exception as e:
                if attempt + 1 == self.retries:
                    raise
                self.sleep(wait_after(attempt, str(e), self.first_wait))
        raise ValueError("no attempt is allowed")

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]
