"""Small model answers and clients."""

import json

VERDICT = {
    "explicit_words": [],
    "reason_for_flag": "fine",
    "topic_of_tweet": ["news"],
    "deletion": "KEEP",
}


def envelope(key, text, url="https://posts.example/u/status/1"):
    body = {"candidates": [{"content": {"parts": [{"text": text}]}}]}
    return json.dumps({"key": key, "tweet_url": url, "response": body})


def answer(key, **changes):
    return envelope(key, json.dumps({**VERDICT, **changes}))


def keep_all_factory(log_dir=None, fail_first=0, error="429 too many requests"):
    """Clients that keep every post; each call leaves a file in log_dir."""

    def make():
        class KeepAll:
            calls = 0

            def run_batch(self, lines):
                import json
                import os
                import uuid

                self.calls += 1
                if log_dir:
                    with open(os.path.join(log_dir, uuid.uuid4().hex), "w") as f:
                        f.write(str(len(lines)))
                if self.calls <= fail_first:
                    raise RuntimeError(error)
                out = []
                for line in lines:
                    r = json.loads(line)
                    verdict = {"explicit_words": [], "reason_for_flag": "ok", "topic_of_tweet": [], "deletion": "KEEP"}
                    body = {"candidates": [{"content": {"parts": [{"text": json.dumps(verdict)}]}}]}
                    out.append(json.dumps({"key": r["key"], "tweet_url": r["tweet_url"], "response": body}))
                return out

        return KeepAll()

    return make
