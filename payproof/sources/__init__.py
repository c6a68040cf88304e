"""From raw export files to exact numbered lines, and from lines to typed tables."""
