import pytest

from chronolith.sources.http import Answer, GaveUp, RateWindow, get, next_link, pages, waits


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def limit(clock, capacity=900, seconds=60.0):
    return RateWindow(capacity, seconds, clock, clock.sleep)


def test_success():
    c = Clock()
    assert get("u", lambda u: Answer(200, {"foo": "bar"}), limit(c)).body == {"foo": "bar"} and c.slept == []


def test_rate_limit_sleeps_until_reset_and_tries_again():
    c, answers = Clock(), [Answer(403, None, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "7"}), Answer(200, 1)]
    assert get("u", lambda u: answers.pop(0), limit(c), now=c).body == 1 and c.slept == [7.0]


def test_permanent_failure():
    c = Clock()
    with pytest.raises(GaveUp) as e:
        get("u", lambda u: Answer(503), limit(c), now=c)
    assert e.value.status == 503 and c.slept == [1.0, 2.0, 4.0, 8.0]
    with pytest.raises(GaveUp):
        get("u", lambda u: Answer(403), limit(c), now=c)
    assert get("u", lambda u: Answer(404), limit(c), now=c) is None


def test_window_never_holds_more_than_its_capacity():
    c = Clock()
    w, at = limit(c, 3, 10.0), []
    for _ in range(10):
        w.acquire()
        at.append(c.now)
        c.now += 1
    assert all(sum(a <= x < a + 10 for x in at) <= 3 for a in at)


def test_pages():
    c = Clock()
    site = {"1": Answer(200, [1, 2], {"Link": '<2>; rel="next", <9>; rel="last"'}), "2": Answer(200, [3], {"link": '<3>; rel="next"'}), "3": Answer(200, [4])}
    assert list(pages("1", site.get, limit(c))) == [[1, 2], [3], [4]]
    assert list(pages("1", site.get, limit(c), known=lambda x: x == [3])) == [[1, 2]]
    assert next_link({}) is None and next_link({"Link": '<9>; rel="last"'}) is None


def test_secondary_limits_wait_as_long_as_they_say():
    c = Clock()
    answers = [Answer(403, "You have exceeded a Secondary Rate Limit", {"retry-after": "7"}), Answer(403, {"message": "secondary rate limit"}), Answer(429, None, {"Retry-After": "3"}), Answer(200, 1)]
    assert get("u", lambda u: answers.pop(0), limit(c), now=c).body == 1
    assert 8 <= c.slept[0] <= 12 and 61 <= c.slept[1] <= 65 and c.slept[2] == 3
    with pytest.raises(GaveUp):
        get("u", lambda u: Answer(403, "not allowed"), limit(c), now=c)


def test_retry_after_may_be_a_date():
    at = Answer(429, None, {"Retry-After": "Wed, 21 Oct 2015 07:28:30 GMT"})
    assert waits(at, 0, 1445412500.0) == 10.0 and waits(at, 0, 2e9) == 0.0
    assert waits(Answer(429, None, {"Retry-After": "7"}), 0, 0.0) == 7.0 and waits(Answer(429, None, {"Retry-After": "soon"}), 3, 0.0) == 8.0
