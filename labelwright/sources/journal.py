"""Answers of a running job, one small file each: a task that is lost asks only for the rest.

A file is named by its prompt's SHA-256 and appears whole, by a rename. Tasks look a prompt
up before they call the model. The folder must be one that every executor reaches, on a
file system that Arrow opens (local or mounted, HDFS, S3, GCS). It is not the log: the log
takes its rows over (``sources.answers.adopt``), and the folder is removed then.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs


class Journal:
    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)
        self.files.create_dir(self.root, recursive=True)

    def _place(self, prompt: str) -> str:
        return f"{self.root}/{hashlib.sha256(prompt.encode('utf-8', 'surrogatepass')).hexdigest()}.json"

    def find(self, prompt: str) -> dict | None:
        """The answer to ``prompt`` if one is kept."""
        place = self._place(prompt)
        if self.files.get_file_info(place).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(place) as file:
            return json.loads(file.read())

    def keep(self, prompt: str, answer: dict) -> None:
        place = self._place(prompt)
        draft = f"{place}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as file:
            file.write(json.dumps(answer).encode())
        try:
            self.files.move(draft, place)
        except OSError:
            # Another attempt of this task was first; its answer stands.
            if self.files.get_file_info(place).type != fs.FileType.File:
                raise
            self.files.delete_file(draft)
