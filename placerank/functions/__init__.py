from placerank.functions.expr import *  # noqa: F401,F403
