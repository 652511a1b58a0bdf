"""Content sources: directories, bare git repositories, configuration."""
