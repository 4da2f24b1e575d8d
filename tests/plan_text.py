"""The text of a plan, for tests of its shape."""


def plan_of(df) -> str:
    """The text ``explain`` prints, before the query has run."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
