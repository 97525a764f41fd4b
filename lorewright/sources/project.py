"""A new project folder with its settings and container files."""

from __future__ import annotations

from pathlib import Path

from lorewright.plans.config import write_yaml

PACKAGE = "lorewright"


def agent_settings(name: str) -> dict:
    return {
        "agent": {"name": name, "version": "0.1.0", "description": f"Answers from the documents of {name}.", "system_prompt": "Answer from the context you are given. Say so when it does not hold the answer."},
        "runtime": {"embedder": {"dimensions": 1024, "max_tokens": 0, "parallel": False}},
        "mcp": {"tools": []},
        "server": {"port": 8000, "cors_origins": ["*"]},
    }


def project_files(name: str) -> dict[str, str]:
    keys = ("LLM_BASE_URL", "LLM_API_KEY", "LLM_MODEL", "EMBED_BASE_URL", "EMBED_API_KEY", "EMBED_MODEL", "RERANK_BASE_URL", "RERANK_API_KEY", "RERANK_MODEL", "AGENT_API_KEY", "PORT")
    image = f'FROM python:3.13-slim\nRUN apt-get update && apt-get install -y --no-install-recommends default-jre-headless\nWORKDIR /app\nCOPY . .\nEXPOSE 8000\nCMD ["python", "-m", "{PACKAGE}.plans.cli", "serve", "--dir", "."]\n'
    compose = write_yaml({"services": {name.lower().replace(" ", "-"): {"build": ".", "ports": ["8000:8000"], "env_file": [".env"]}}})
    readme = f"# {name}\n\nPut documents (.md, .txt, .pdf) into data/, then:\n\n    python -m {PACKAGE}.plans.cli compile --dir .\n    python -m {PACKAGE}.plans.cli serve --dir .\n"
    return {"agent.yaml": write_yaml(agent_settings(name)), "Dockerfile": image, ".env.example": "".join(f"{k}=\n" for k in keys), ".dockerignore": ".env\n.git\n", "README.md": readme, "docker-compose.yml": compose}


def create_project(folder: str, name: str) -> list[str]:
    """Write a new project; an existing folder is an error."""
    root = Path(folder)
    if root.exists():
        raise FileExistsError(f"{folder} exists already")
    (root / "data").mkdir(parents=True)
    files = project_files(name)
    for path, text in files.items():
        (root / path).write_text(text)
    return sorted(files)
