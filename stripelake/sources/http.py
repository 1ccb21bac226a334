"""HTTP requests from rows, as a table function."""

from __future__ import annotations

import urllib.error
import urllib.request

from pyspark.sql.functions import udtf


@udtf(returnType="status int, content_type string, content string")
class HttpRequest:
    """http_request(method, url, body, type): one row with the answer; a failed connection has status 0 and the reason."""

    def eval(self, method: str, url: str, body: str, content_type: str):
        request = urllib.request.Request(url, data=body.encode() if body is not None else None, method=method, headers={"Content-Type": content_type} if content_type else {})
        try:
            with urllib.request.urlopen(request, timeout=30) as answer:
                yield answer.status, answer.headers.get("Content-Type"), answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            yield e.code, e.headers.get("Content-Type"), e.read().decode("utf-8", "replace")
        except OSError as e:
            yield 0, None, str(e)
