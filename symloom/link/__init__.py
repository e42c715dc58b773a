"""From facts of single files to one linked graph, and the passes that refine it."""
