"""Models behind the labeler: a chat server over HTTP, or a local engine. Both give a function from prompts to answers
(null for a failure), as ``operators.prompts.labelled`` wants it."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

Call = Callable[[list[str]], list[str | None]]


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def server(url: str, model: str, system: str, *, temperature: float = 0.7, max_tokens: int = 700, timeout: float = 120, tries: int = 4, workers: int = 16, post: Callable[[str, dict, float], dict] = _post, wait: Callable[[float], None] = time.sleep) -> Call:
    """Chat completions of a server, ``workers`` at a time in every task. Network errors, timeouts and answers without
    choices are tried again after 2, 4, 6, ... seconds; what still fails is null."""

    def one(prompt: str) -> str | None:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        body = dict(max_tokens=max_tokens, messages=messages, model=model, temperature=temperature)
        for k in range(tries):
            try:
                first = post(url, body, timeout)["choices"][0]
                return first["message"]["content"]
            except (KeyError, IndexError, TimeoutError, urllib.error.URLError):
                wait(2 * (k + 1))
        return None

    def call(prompts: list[str]) -> list[str | None]:
        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(one, prompts))

    return call


def local(model: str, system: str, *, temperature: float = 0.7, max_tokens: int = 700, **engine) -> Call:
    """A vLLM engine inside the task (needs the package and a GPU resource profile); loaded once in each worker."""
    loaded: dict = {}

    def call(prompts: list[str]) -> list[str | None]:
        from vllm import LLM, SamplingParams

        if not loaded:
            loaded["llm"] = LLM(model=model, **engine)
        chats = [[{"role": "system", "content": system}, {"role": "user", "content": p}] for p in prompts]
        return [x.outputs[0].text for x in loaded["llm"].chat(chats, SamplingParams(temperature=temperature, max_tokens=max_tokens))]

    return call
