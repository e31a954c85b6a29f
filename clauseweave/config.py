"""Environment-backed settings of the question-answering loop."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

DEFAULT_TOOL_CALLS = 6


def read_env_file(path: str | Path) -> dict[str, str]:
    """NAME=value lines of a dotenv file; a byte-order mark is tolerated."""
    source = Path(path)
    if not source.is_file():
        return {}
    values = {}
    for line in source.read_text(encoding="utf-8-sig").splitlines():
        name, found, value = line.strip().partition("=")
        if found and not name.startswith("#"):
            values[name.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return values


@dataclass(frozen=True)
class Settings:
    api_key: str
    model: str
    base_url: str | None = None
    max_tool_calls: int = DEFAULT_TOOL_CALLS

    @classmethod
    def load(cls, env_file: str | Path = ".env", environ: Mapping[str, str] | None = None) -> "Settings":
        """Process variables win over the file; key and model are mandatory."""
        values = {**read_env_file(env_file), **(os.environ if environ is None else environ)}

        def text(name: str) -> str:
            return values.get(name, "").strip()

        for name in ("OPENAI_API_KEY", "OPENAI_MODEL"):
            if not text(name):
                raise RuntimeError(f"{name} is missing; set it in the environment or the .env file")
        return cls(
            api_key=text("OPENAI_API_KEY"),
            model=text("OPENAI_MODEL"),
            base_url=text("OPENAI_BASE_URL") or None,
            max_tool_calls=int(text("CLAUSEWEAVE_MAX_TOOL_CALLS") or DEFAULT_TOOL_CALLS),
        )


def create_client(settings: Settings):
    """Responses-API client; its library is optional."""
    try:
        from openai import OpenAI
    except ImportError as error:
        raise RuntimeError("the 'openai' package is needed to ask questions") from error
    address = {"base_url": settings.base_url} if settings.base_url else {}
    return OpenAI(api_key=settings.api_key, **address)
