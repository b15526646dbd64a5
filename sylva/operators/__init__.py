"""DataFrame operators over files, nodes, content maps and revisions."""
