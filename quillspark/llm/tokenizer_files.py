"""Where the public tokenizers' files lie; the folder is a parameter and nothing is copied from it."""

from __future__ import annotations

import os

DEFAULT_FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A tokenizer's file: below `folder`, else where the public_tokenizers module keeps it, else the default folder."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(DEFAULT_FOLDER, name)
    return public_tokenizers.path(name)
