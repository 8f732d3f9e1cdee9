"""A fetcher for the stream tests: channels as files of ids, every fetch noted in a file of its own."""

import json
import uuid
from pathlib import Path

SIZE = 4


def page(channel, ids):
    return "".join(f'<div class="tgme_widget_message" data-post="{channel}/{i}"><div class="tgme_widget_message_text">text {i}</div></div>' for i in ids)


class Files:
    def __init__(self, folder):
        self.folder = Path(folder)

    def fetch(self, channel, before=None):
        (self.folder / f"asked-{uuid.uuid4().hex}").write_text(json.dumps([channel, before]))
        file = self.folder / f"{channel}.ids"
        if not file.exists():
            return None
        ids = sorted((i for i in map(int, file.read_text().split()) if before is None or i < before), reverse=True)
        return page(channel, ids[:SIZE])

    def asked(self):
        return sorted((json.loads(f.read_text()) for f in self.folder.glob("asked-*")), key=repr)
