"""Graph, ranking, spreading and statistics operators."""
