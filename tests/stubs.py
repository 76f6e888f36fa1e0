"""Clients for tests, by name."""

import json

from quillspark.sources.connectors import Transcript, TranscriptError


class Client:
    model = "stub"

    def chat(self, messages, **options):
        return json.dumps({"found": "плов" in messages[-1]["content"].split("Fragments")[0], "dish": "плов", "ingredients": ["рис 200 г"], "steps": ["варить"], "source_n": 1})

    def health(self):
        return True


class Silent(Client):
    def health(self):
        raise OSError("refused")


def fetcher():
    def fetch(video_id):
        if video_id == "none":
            raise TranscriptError("no transcript")
        return Transcript([(f"варим плов {video_id}.", 0.0, 2.0)], "ru", False, "ytapi")

    return fetch
