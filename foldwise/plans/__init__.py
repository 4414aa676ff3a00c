"""Plan shapes that keep global order and prefix sums off a single task."""
