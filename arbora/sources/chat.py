"""A client of chat services: one request for each prompt, a bounded number of them at a time."""

from __future__ import annotations

import json
import os
import urllib.request
from concurrent.futures import ThreadPoolExecutor

KEY = "ARBORA_MODEL_KEY"


class ChatService:
    """Posts prompts to ``url``/chat/completions, as many services understand it.

    Instances go to the executors with the functions that hold them; the key is read there, from the environment, and isn't sent
    along.  Replies are pairs of a text and the reason why it ended.
    """

    def __init__(self, url: str, model: str, concurrency: int = 5, timeout: float = 300, most_tokens: int = 8192, temperature: float = 0.0):
        if concurrency < 1:
            raise ValueError("at least one request must be possible at a time")
        self.url, self.model, self.concurrency, self.timeout = url.rstrip("/"), model, concurrency, timeout
        self.options = {"max_tokens": most_tokens, "temperature": temperature}

    def chat(self, prompt: str, history: list[dict] | None = None) -> tuple[str, str]:
        """One reply; ``history`` has turns of role and content, those that aren't the user's being the assistant's."""
        said = [{"role": "user" if t["role"] == "user" else "assistant", "content": t["content"]} for t in history or []]
        turns = [*said, {"role": "user", "content": prompt}]
        body = json.dumps({"model": self.model, "messages": turns, **self.options}).encode()
        headers = {"Content-Type": "application/json"}
        if key := os.environ.get(KEY):
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(f"{self.url}/chat/completions", body, headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            choice = json.load(reply)["choices"][0]
        return choice["message"].get("content") or "", choice.get("finish_reason") or ""

    def converse(self, conversations: list[list[dict]]) -> list[tuple[str, str]]:
        """A reply to each list of turns, the last of which is the user's."""
        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(lambda turns: self.chat(turns[-1]["content"], turns[:-1]), conversations))

    def __call__(self, prompts: list[str]) -> list[tuple[str, str]]:
        return self.converse([[{"role": "user", "content": p}] for p in prompts])
