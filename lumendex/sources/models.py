"""Model artefacts in two folders: the index's own, then the user's, then a download."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

# The files of a complete model, in the snapshot layout of public model hubs.
REQUIRED = ("config.json", "tokenizer.json", "model.safetensors")


def _folder(cache: str, model: str) -> str:
    return os.path.join(cache, "models--" + model.replace("/", "--"))


def snapshot(cache: str, model: str) -> str | None:
    """The folder of a model's current snapshot, if all its files are there."""
    ref = os.path.join(_folder(cache, model), "refs", "main")
    if not os.path.isfile(ref):
        return None
    with open(ref, encoding="utf-8") as f:
        path = os.path.join(_folder(cache, model), "snapshots", f.read().strip())
    return path if all(os.path.exists(os.path.join(path, name)) for name in REQUIRED) else None


class ModelCache:
    """own: the folder beside the index; shared: the user's. download(model, folder) fills a folder in that layout."""

    def __init__(self, own: str, shared: str, download: Callable[[str, str], None] | None = None):
        self.own, self.shared, self.download = own, shared, download

    def resolve(self, model: str) -> str:
        """The snapshot in the own folder, copied or downloaded first where it is missing."""
        if found := snapshot(self.own, model):
            return found
        if not snapshot(self.shared, model):
            if self.download is None:
                raise FileNotFoundError(f"model {model} is in neither {self.own} nor {self.shared}")
            os.makedirs(self.shared, exist_ok=True)
            self.download(model, self.shared)
            if not snapshot(self.shared, model):
                raise FileNotFoundError(f"the download of {model} lacks one of {', '.join(REQUIRED)}")
        os.makedirs(self.own, exist_ok=True)
        part = tempfile.mkdtemp(dir=self.own)
        shutil.copytree(_folder(self.shared, model), part, symlinks=False, dirs_exist_ok=True)
        shutil.rmtree(_folder(self.own, model), ignore_errors=True)  # an incomplete copy
        os.replace(part, _folder(self.own, model))
        return snapshot(self.own, model)
