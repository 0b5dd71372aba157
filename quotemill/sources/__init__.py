"""Where raw messages and source settings come from."""
