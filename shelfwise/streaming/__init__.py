"""Row-wise steps on a stream: the inventory has no streaming operator, but
every stateless step also runs on a streaming DataFrame."""
