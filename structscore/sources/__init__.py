"""Where rows come from and go to: JSON lines, images, answer sources, tables."""
